"""Link resolution and rewriting (JOIN-6, JOIN-9, RWR-1, RWR-2, JOIN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import pii as PII
from ..functions import text as T
from ..functions import urls as U
from ..profile import SiteProfile
from . import privacy as PR
from .extract import NON_ASSET_PREFIXES, _starts_any
from .scope import excluded


def resolution(edges: DataFrame, page_map: DataFrame, asset_map: DataFrame | None = None) -> DataFrame:
    """JOIN-6: canonical target -> bundle path; pages first, then assets,
    else external (left unchanged).  Maps are (url, path) frames; both joins
    are equi-joins on the URL, so AQE picks broadcast or shuffle by size."""
    pm = page_map.select(F.col("url").alias("dst"), F.col("path").alias("page_path")).dropDuplicates(["dst"])
    out = edges.join(pm, "dst", "left")
    if asset_map is not None:
        am = asset_map.select(F.col("url").alias("dst"), F.col("path").alias("asset_path")).dropDuplicates(["dst"])
        out = out.join(am, "dst", "left")
        tgt = F.coalesce("page_path", "asset_path")
    else:
        tgt = F.col("page_path")
    return out.withColumn("target_path", tgt).withColumn("internal", F.col("target_path").isNotNull()) \
        .drop("page_path", "asset_path")


def unique_path(path: Column, url: str = "url") -> Column:
    """The path of a row, each path once, and none that the home index needs: of several URLs with one
    path the smallest keeps it, the others get a key suffix.  For rows of distinct URLs."""
    same = Window.partitionBy(path).orderBy(url)
    suffix = F.concat(F.lit("~"), F.substring(U.url_key(F.col(url)), 1, 10))
    named = F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), suffix, F.regexp_extract(path, r"(\.[^./]*)$", 1))
    taken = (F.row_number().over(same) > 1) | path.rlike(r"^(index(-\d+)?\.html|authors/.*)$")
    return F.when(taken, named).otherwise(path)


def unique_paths(urls: DataFrame) -> DataFrame:
    """(url, path) with each path once, as ``unique_path`` has them."""
    return urls.select("url", "path").distinct().withColumn("path", unique_path(F.col("path")))


def asset_todo(targets: DataFrame, stored: DataFrame, profile: SiteProfile, col: str = "dst") -> DataFrame:
    """FLT-13: distinct assets to fetch: not stored yet and not excluded (assets
    are not limited to the include patterns)."""
    wanted = targets.select(F.col(col).alias("url")).distinct().where(~excluded(F.col("url"), profile))
    return wanted.join(stored.select("url"), "url", "left_anti")


def asset_paths(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """JOIN-7: stored files (file_name) with the manifest's asset of that name
    (key and extension) -> url, path; files that no line names are dropped."""
    named = manifest.select(F.concat("key", "ext").alias("file_name"), "url", "ext", "content_type")
    return files.join(named, "file_name").withColumn("path", U.asset_path(F.col("url"), F.col("ext")))


def stored_flags(targets: DataFrame, stored: DataFrame, col: str = "dst") -> DataFrame:
    """JOIN-9: mark targets already in the store (semi-join semantics)."""
    s = stored.select(F.col("url").alias(col)).distinct().withColumn("is_stored", F.lit(True))
    return targets.join(s, col, "left").withColumn("is_stored", F.coalesce("is_stored", F.lit(False)))


# Elements whose references are rewritten, and their attributes.
REWRITE_TAGS = ("a", "img", "link", "script", "source")
REWRITE_ATTRS = ("href", "src")
# A start tag up to its reference, and the reference in any quoting.
_HEAD = rf"^(?:{'|'.join(REWRITE_TAGS)})(?:\s[^<>]*?)?\s(?:{'|'.join(REWRITE_ATTRS)})\s*=\s*"
_TAG = rf"(?i)^(?:{'|'.join(REWRITE_TAGS)})\s"
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))"""
REF_RE = f"(?is){_HEAD}{_VALUE}"


def tag_pieces(html: Column) -> Column:
    """Markup cut after every '<': each later piece starts with a tag's name."""
    return F.split(html, "(?<=<)")


def piece_ref(piece: Column) -> Column:
    """The reference that a piece's start tag holds, decoded; '' when none."""
    ref = H.decode_entities(F.concat(*[F.regexp_extract(piece, REF_RE, i) for i in (1, 2, 3)]))
    return F.when(piece.rlike(_TAG), ref).otherwise(F.lit(""))


def rewrite_pages(pages: DataFrame, page_map: DataFrame, profile: SiteProfile,
                  asset_map: DataFrame | None = None, rules=None) -> DataFrame:
    """RWR-1: rewrite resolvable refs of a/img/link/script/source, in any
    quoting, to bundle paths relative to the page; externals stay as they are.
    With ``rules`` (a tuple, maybe empty) the page also loses its login blocks
    and addresses first, and is scrubbed by the rules last (PRV-1..3).

    ``pages`` has (page_id, page_url, path, html).  The distinct refs of each
    page are resolved by one equi-join against the map, collected back per page
    as a ref->path map and applied inside the row: the HTML is shuffled once,
    for the join back."""
    if rules is not None:
        pages = PR.strip_blocks(pages, profile)
        pages = pages.withColumn("html", PR.redact_emails(F.col("html"), profile))
    refs = F.array_distinct(F.filter(F.transform(tag_pieces(F.col("html")), piece_ref),
                                     lambda r: (r != "") & ~_starts_any(r, NON_ASSET_PREFIXES)))
    refs = pages.select("page_id", "page_url", F.explode(refs).alias("ref"))
    refs = refs.withColumn("dst", U.canonical(F.col("ref"), profile.strip_query_keys, F.col("page_url")))
    resolved = resolution(refs, page_map, asset_map).where("internal")
    per_page = resolved.groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ref", "target_path"))).alias("m"))
    joined = pages.join(per_page, "page_id", "left")
    up = U.up_prefix(F.col("path"))

    def piece(x):
        def new(t):
            return F.when(t.isNull(), F.struct(x.alias("x"), F.lit(0).alias("n"))).otherwise(F.struct(F.concat(
                F.regexp_extract(x, f"(?is)({_HEAD})", 1), F.lit('"'), T.html_escape(F.concat(up, t)), F.lit('"'),
                F.regexp_replace(x, REF_RE, "")).alias("x"), F.lit(1).alias("n")))
        return U.let(F.try_element_at(F.col("m"), piece_ref(x)), new)

    done = joined.withColumn("_d", F.when(F.col("m").isNotNull(), F.transform(tag_pieces(F.col("html")), piece)))
    html = F.coalesce(F.array_join(F.transform("_d", lambda d: d["x"]), ""), F.col("html"))
    n = F.coalesce(F.aggregate("_d", F.lit(0), lambda a, d: a + d["n"]), F.lit(0))
    return done.select("page_id", "path", PII.scrub(html, rules or ()).alias("html"), n.alias("n_rewritten"))


# Fixed value: a stylesheet's reference.
CSS_URL_RE = r"""url\(\s*['"]?([^'")]+)['"]?\s*\)"""


def css_refs(css: DataFrame, profile: SiteProfile) -> DataFrame:
    """EXT-14: ``url(...)`` references of stylesheets (css_url, text): data:
    and '#' refs skipped, resolved against the stylesheet, distinct,
    same-origin only (no recursion into further stylesheets)."""
    refs = F.transform(F.regexp_extract_all(F.col("text"), F.lit(CSS_URL_RE), 1), lambda x: F.trim(x))
    refs = F.filter(refs, lambda x: ~x.startswith("data:") & ~x.startswith("#"))
    canon = F.transform(refs, lambda x: U.canonical(x, profile.strip_query_keys, F.col("css_url")))
    same = F.filter(F.array_distinct(canon), lambda u: U.same_site(u, F.col("css_url")))
    return css.select("css_url", F.posexplode(same).alias("seq", "ref"))


def rewrite_css(css: DataFrame, page_map: DataFrame, profile: SiteProfile, asset_map: DataFrame | None = None) -> DataFrame:
    """RWR-2: ``url(...)`` refs that resolve to archived entries become
    paths relative to the stylesheet's bundle path; others stay.  Input
    (css_url, path, text)."""
    pieces = F.split(F.col("text"), r"(?i)(?=url\()")
    refs = css.select("css_url", F.posexplode(pieces).alias("i", "piece")).where(F.col("piece").rlike(r"(?i)^" + CSS_URL_RE))
    refs = refs.withColumn("ref", F.trim(F.regexp_extract("piece", r"(?i)^" + CSS_URL_RE, 1)))
    refs = refs.where(~F.col("ref").startswith("data:") & ~F.col("ref").startswith("#"))
    refs = refs.withColumn("dst", U.canonical(F.col("ref"), profile.strip_query_keys, F.col("css_url")))
    res = resolution(refs, page_map, asset_map).where("internal")
    per = res.groupBy("css_url").agg(F.map_from_entries(F.collect_list(F.struct("i", "target_path"))).alias("m"))
    j = css.join(per, "css_url", "left")
    up = U.up_prefix(F.col("path"))

    def piece(x, i):
        t = F.try_element_at(F.col("m"), i)
        return F.when(t.isNull(), x).otherwise(
            F.concat(F.lit("url("), up, t, F.lit(")"), F.regexp_replace(x, r"(?i)^" + CSS_URL_RE, "")))

    new = F.when(F.col("m").isNull(), F.col("text")).otherwise(F.array_join(F.transform(pieces, piece), ""))
    return j.select("css_url", "path", new.alias("text"), F.coalesce(F.size("m"), F.lit(0)).alias("n_rewritten"))
