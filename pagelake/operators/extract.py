"""Page -> record extraction jobs (EXT-*).

Jobs on single tags are narrow: each page row is turned into arrays with
built-in regex/array expressions and exploded where one row per record is
wanted.  Order-preserving first-seen dedup (WIN-1) happens inside the row with
``array_distinct``, so link extraction needs no shuffle at all.  Jobs on blocks
(posts, categories, attachments) read the page node table (``nodes``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..profile import SiteProfile
from . import nodes as N
from .order import last_row

# Reference prefixes that are never followed as links.
NON_NAV_PREFIXES = ("#", "javascript:", "mailto:", "tel:")
# ... and never rewritten / fetched as assets.
NON_ASSET_PREFIXES = ("#", "data:", "javascript:", "mailto:", "tel:")


def _starts_any(c: Column, prefixes) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | c.startswith(p)
    return cond


def with_page_url(pages: DataFrame, profile: SiteProfile, url_col: str = "url") -> DataFrame:
    """Add ``page_url`` (canonical) and ``key`` (sha1 of it)."""
    return (pages.withColumn("page_url", U.canonical(F.col(url_col), profile.strip_query_keys))
            .withColumn("key", U.url_key(F.col("page_url"))))


def latest_per_key(df: DataFrame, order_col: str = "page_id") -> DataFrame:
    """SNK-1 / WIN-2: one stored page per key, the last write (highest ``order_col``) wins.
    Callers that need few columns should select them before, so that markup is not shuffled."""
    return last_row(df, "key", order_col)


def site_base(profile: SiteProfile) -> Column:
    """Base URL used for the same-site test: the profile's, else the page's own."""
    return F.lit(profile.base_url) if profile.base_url else F.col("page_url")


# ---------------------------------------------------------------- titles ---
def title_expr(html: Column) -> Column:
    """EXT-1: trimmed text of the first <title>, null when there is none."""
    return F.when(H.has_element(html, r"<title\b"), H.text(H.inner(html, r"<title\b[^>]*>", r"</title\s*>")))


def topic_title_expr(html: Column, profile: SiteProfile) -> Column:
    """EXT-9: text of the first topic-title element."""
    return F.when(H.has_element(html, profile.topic_title_tag),
                  H.text(H.inner(html, profile.topic_title_tag, r"</h1\s*>")))


def crumbs_expr(html: Column, block: str, end: str) -> Column:
    """EXT-3: ordered non-empty anchor texts inside a block."""
    frag = H.inner(html, block, end)
    return F.filter(F.transform(H.anchors(frag), lambda a: a["text"]), lambda t: t != "")


def forum_crumbs_expr(html: Column, profile: SiteProfile) -> Column:
    """EXT-9: non-empty item texts of the forum breadcrumb (linked or plain)."""
    frag = H.inner(html, profile.forum_crumb_block, r"</(?:ul|nav)\s*>")
    items = F.filter(F.split(frag, r"(?i)<li(?=[\s>])"), lambda x, i: i > 0)
    items = F.transform(items, lambda x: H.text(F.regexp_replace(F.regexp_replace(x, r"(?is)</li\s*>.*$", ""), r"^[^>]*>", "")))
    return F.when(H.has_element(html, profile.forum_crumb_block),
                  F.filter(items, lambda t: t != "")).otherwise(F.array().cast("array<string>"))


def page_titles(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    h = F.col("html")
    return pages.select("page_id", title_expr(h).alias("title"),
                        topic_title_expr(h, profile).alias("topic_title"))


# ----------------------------------------------------------------- links ---
def link_targets(html: Column, base: Column, profile: SiteProfile) -> Column:
    """EXT-4 + FLT-1 + P-1/P-2 + WIN-1: canonical hyperlink targets of a page,
    first occurrence kept, document order."""
    hrefs = F.filter(H.hrefs(html), lambda x: (x != "") & ~_starts_any(x, NON_NAV_PREFIXES))
    return F.array_distinct(F.transform(hrefs, lambda x: U.canonical(x, profile.strip_query_keys, base)))


def link_edges(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """One row per (page, first-seen target): page_id, seq (0-based), dst."""
    p = with_page_url(pages, profile)
    return (p.select("page_id", "page_url", F.posexplode(link_targets(F.col("html"), F.col("page_url"), profile))
                     .alias("seq", "dst")))


def _in_dirs(x: Column, dirs) -> Column:
    c = F.lit(False)
    for d in dirs:
        c = c | x.contains(d)
    return c


def attachment_edges(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """EXT-5: links into an upload directory or of the attachment class, then those inside an
    attachment block; canonical, not deduped.  One row a link: page_id, seq, dst."""
    def links(ns, inside):
        def one(x):
            # a link of the class inside a block counts as both, one into a directory only once
            in_dir = lambda href: _in_dirs(href, profile.upload_dirs)
            return U.let(H.attr(x["token"], "href"), lambda href: F.transform(F.array_compact(F.array(
                F.when((href != "") & (H.has_class(x["token"], profile.attachment_class) | in_dir(href)), 0),
                F.when((href != "") & F.get(inside, x["pos"]) & ~in_dir(href), 1))),
                lambda how: F.struct(how.alias("how"), x["pos"].alias("pos"), href.alias("href"))))
        return F.sort_array(F.flatten(F.transform(F.filter(ns, lambda x: (x["name"] == "a") & (x["kind"] == N.START)), one)))

    def found(ns):
        if not profile.attachment_block:
            return links(ns, F.array(F.lit(False)))
        return U.let(N.in_blocks(ns, lambda x: N.is_tag(x["token"], profile.attachment_block)), lambda inside: links(ns, inside))

    p = N.dealt(with_page_url(pages, profile), "page_id", "page_url")
    # an outer one: for the other, Spark would filter pages by the size of the array, and build it once more
    rows = p.select("page_id", "page_url", F.posexplode_outer(U.let(N.page_nodes(F.col("html")), found)).alias("seq", "l"))
    return rows.where(F.col("seq").isNotNull()).select("page_id", "seq", U.canonical(F.col("l.href"), profile.strip_query_keys, F.col("page_url")).alias("dst"))


def subresource_targets(html: Column, base: Column, site: Column, profile: SiteProfile) -> Column:
    """EXT-6: same-site stylesheets, then scripts, then images; deduped."""
    def refs(tags):
        def values(tag, attr, also=lambda t: F.lit(True)):
            return F.transform(F.filter(tags, lambda t: t.rlike(rf"(?i)^<{tag}[\s/>]") & also(t)), lambda t: H.attr(t, attr))
        sheet = lambda t: t.rlike(r"""(?is)^[^>]*\srel\s*=\s*["']?(?:[^"'>]*\s)?stylesheet(?:[\s"'>]|$)""")
        return F.concat(values("link", "href", sheet), values("script", "src"), values("img", "src"))

    # of a script or style only its start tag
    tags = F.transform(N.start_tags(html, "link", "script", "img"), lambda t: F.regexp_extract(t, f"(?s)^(<{N._REST}>)", 1))
    own = F.filter(U.let(tags, refs), lambda x: (x != "") & ~x.startswith("data:") & ~x.startswith("#"))
    canon = F.transform(own, lambda x: U.canonical(x, profile.strip_query_keys, base))
    return F.array_distinct(F.filter(canon, lambda u: U.same_site(u, site)))


def subresource_edges(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    p = with_page_url(pages, profile)
    return p.select("page_id", F.posexplode(
        subresource_targets(F.col("html"), F.col("page_url"), site_base(profile), profile)).alias("seq", "dst"))


def first_token(html: Column, profile: SiteProfile) -> Column:
    """EXT-2: first non-empty value of the token attribute."""
    return F.try_element_at(F.filter(H.all_attr(html, profile.token_attr), lambda v: v != ""), F.lit(1))


def endpoints(html: Column, base: Column, profile: SiteProfile) -> Column:
    """EXT-7: endpoint attribute values resolved against the page (not
    canonicalised, not deduped)."""
    vals = F.filter(H.all_attr(html, profile.endpoint_attr), lambda v: v != "")
    return F.transform(vals, lambda v: U.resolve(v, base))


def next_page(html: Column, base: Column, profile: SiteProfile) -> Column:
    """EXT-12: link of the paginator's last item, else the first rel=next link,
    else null.  On the last page the last item has no link."""
    frag = H.drop_invisible(H.inner(html, profile.paginator_block, profile.paginator_end))
    if profile.paginator_item:
        frag = F.try_element_at(F.filter(F.split(frag, f"(?i)(?={profile.paginator_item})"), lambda x, i: i > 0), F.lit(-1))
    last = F.try_element_at(F.filter(H.hrefs(F.coalesce(frag, F.lit(""))), lambda x: x != ""), F.lit(-1))
    rel = F.regexp_extract(H.drop_invisible(html), r"""(?is)(<a\b[^>]*\srel\s*=\s*["']?next\b[^>]*>)""", 1)
    rel_href = F.when(rel.rlike(r"(?is)\shref\s*="), H.attr(F.regexp_replace(rel, r"^<a", " "), "href"))
    ref = F.coalesce(last, F.when(rel_href != "", rel_href))
    return F.when(ref.isNotNull(), U.canonical(ref, profile.strip_query_keys, base))


def nav_links(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """EXT-13: menu links with their anchor text (URL-derived when empty)."""
    p = with_page_url(pages, profile)
    a = H.anchors(H.inner(F.col("html"), profile.nav_block, profile.nav_end))
    a = F.filter(a, lambda x: x["has_href"] & (x["href"] != ""))
    out = p.select("page_id", "page_url", F.posexplode(a).alias("seq", "a"))
    dst = U.canonical(F.col("a.href"), profile.strip_query_keys, F.col("page_url"))
    return out.select("page_id", "seq", dst.alias("dst"),
                      F.when(F.col("a.text") != "", F.col("a.text")).otherwise(U.title_from_url(dst)).alias("text"))


# ------------------------------------------------------------ categories ---
def categories(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """EXT-8: one row per category entry: group title, title, canonical url,
    id attribute, digits-only topic count, description.  Entries without a
    link are skipped."""
    p = N.node_arrays(with_page_url(pages, profile), "page_id", "page_url")
    groups = U.let(F.col("nodes"), lambda ns: F.transform(N.elements(ns, profile.group_start), lambda g: N.cut(ns, g)))
    # outer, as in attachment_edges: the array is built once
    g = p.select("page_id", "page_url", F.posexplode_outer(groups).alias("gpos", "g")).where(F.col("gpos").isNotNull())
    items = U.let(F.col("g"), lambda ns: F.transform(N.elements(ns, profile.category_start), lambda c: N.cut(ns, c)))
    c = g.select("page_id", "page_url", "gpos", N.text_of(N.first_block(F.col("g"), r"<h2[\s/>]")).alias("group"),
                 F.posexplode(items).alias("cpos", "c"))
    named = lambda cls: N.text_of(N.first_block(F.col("c"), rf'<[a-z][^>]*class="[^"]*\b{cls}\b'))
    idtag = F.get(N.elements(F.col("c"), rf"<[a-z][^>]*\s{profile.category_id_attr}\s*="), F.lit(0))["token"]
    c = c.select("page_id", "page_url", "gpos", "cpos", "group", N.first_block(
        N.first_block(F.col("c"), r"<h3[\s/>]"), r"<a[\s/>]").alias("link"), idtag.alias("idtag"),
        named("topic-count").alias("count"), named("cat-desc").alias("description"))
    href = H.attr(F.get("link", F.lit(0))["token"], "href")
    return c.where(href != "").select(
        "page_id", "gpos", "cpos", "group", N.text_of(F.col("link")).alias("title"),
        U.canonical(href, profile.strip_query_keys, F.col("page_url")).alias("url"),
        H.attr(F.col("idtag"), profile.category_id_attr).alias("cat_id"),
        T.digits_int(F.col("count")).alias("topic_count"), "description")


# ----------------------------------------------------------------- posts ---
def post_struct(block: Column, base: Column, profile: SiteProfile, reveal_email: bool = False) -> Column:
    """EXT-10/11 on one post's nodes."""
    def mail_of(info):
        start = rf"<[a-z][^>]*\s{profile.email_token_attr}\s*="
        return U.let(N.first_block(info, start), lambda m: F.when(m.isNotNull(), F.struct(
            H.attr(F.get(m, F.lit(0))["token"], profile.email_token_attr).alias("token"),
            T.nullif_blank(N.text_of(m)).alias("visible"))))

    def fields(x):
        byline, lines, mail = x["byline"], N.text_of(x["info"], "\n"), x["mail"]
        at = F.instr(byline, profile.author_sep)
        posted = F.regexp_extract(byline, T.POSTED_RE, 1)
        email = F.lit(None).cast("string")
        if reveal_email:
            from ..functions import pii as P
            email = F.coalesce(P.decode_mail_token(mail["token"], profile.mail_shift), P.email_from_visible(mail["visible"]))
        author = T.nullif_blank(F.substring(byline, at + len(profile.author_sep), 1 << 30))
        return F.struct(
            x["id"].alias("post_id"),
            F.when(at > 0, author).alias("author"),
            F.when(posted != "", posted).alias("timestamp"),
            mail["token"].alias("email_obfuscated"),
            F.when(mail.isNotNull(), email).alias("email"),
            mail["visible"].alias("email_visible"),
            T.after_label(lines, profile.label_updated).alias("updated"),
            T.after_label(lines, profile.label_role).alias("department"),
            T.truncate(x["body"], 280).alias("text_excerpt"),
            x["files"].alias("attachments"),
        )

    def parts(ns):
        start = F.get(ns, F.lit(0))["token"]
        files = F.filter(F.concat(N.attrs(ns, "a", "href"), N.attrs(ns, "img", "src")), lambda r: _in_dirs(r, profile.upload_dirs))
        return U.let(N.first_block(ns, profile.post_info), lambda info: F.struct(
            F.when(start.rlike(rf"(?is)\s{profile.post_id_attr}\s*="), H.attr(start, profile.post_id_attr)).alias("id"),
            N.text_of(N.first_block(ns, profile.post_header), " ").alias("byline"), info.alias("info"),
            N.text_of(N.first_block(ns, profile.post_body), " ").alias("body"), mail_of(info).alias("mail"),
            F.transform(files, lambda r: U.canonical(r, profile.strip_query_keys, base)).alias("files")))

    return U.let(U.let(block, parts), fields)


def post_blocks(nodes: Column, profile: SiteProfile) -> Column:
    """The nodes of each post, from its start tag to its end."""
    return U.let(nodes, lambda ns: F.transform(N.elements(ns, profile.post_start), lambda x: N.cut(ns, x)))


def posts(pages: DataFrame, profile: SiteProfile, reveal_email: bool = False) -> DataFrame:
    """EXT-10: one row per post of every page."""
    p = N.node_arrays(with_page_url(pages, profile), "page_id", "page_url", "key")
    x = p.select("page_id", "page_url", "key", F.posexplode_outer(post_blocks(F.col("nodes"), profile)).alias("pos", "block"))
    x = x.where(F.col("pos").isNotNull())
    return x.select("page_id", "page_url", "key", "pos",
                    post_struct(F.col("block"), F.col("page_url"), profile, reveal_email).alias("p")).select(
        "page_id", "page_url", "key", "pos", "p.*")


# ------------------------------------------------------------ page record --
def record_title(h: Column, profile: SiteProfile, fragment: Column | None = None) -> Column:
    """EXT-15 title: topic title, else the page title (fragments: a fixed label)."""
    frag = fragment if fragment is not None else F.lit(False)
    topic = F.nullif(topic_title_expr(h, profile), F.lit(""))
    return F.coalesce(topic, F.when(frag, F.lit("Forum fragment")).otherwise(title_expr(h)))


def record_breadcrumb(h: Column, profile: SiteProfile) -> Column:
    """EXT-15 breadcrumb: forum crumbs when present, else the page crumbs."""
    forum = forum_crumbs_expr(h, profile)
    page_bc = crumbs_expr(h, profile.breadcrumb_block, profile.breadcrumb_end)
    return U.let(forum, lambda f: F.when(F.size(f) > 0, f).otherwise(page_bc))


def page_records(pages: DataFrame, profile: SiteProfile, status: Column | None = None,
                 content_type: Column | None = None, fragment: Column | None = None,
                 etag: Column | None = None, last_modified: Column | None = None) -> DataFrame:
    """EXT-15: the stored page record (title, breadcrumb, links, endpoints,
    posts, fragment flag, response headers)."""
    null = F.lit(None).cast("string")
    p = with_page_url(pages, profile)
    h, base = F.col("html"), F.col("page_url")
    frag = fragment if fragment is not None else F.lit(False)
    p = N.node_arrays(p, *p.columns)
    post_arr = F.transform(post_blocks(F.col("nodes"), profile), lambda b: post_struct(b, base, profile))
    return p.select(
        "page_id", F.col("page_url").alias("url"), "key",
        (status if status is not None else F.lit(200)).alias("status"),
        (content_type if content_type is not None else F.lit("text/html")).alias("content_type"),
        record_title(h, profile, frag).alias("title"),
        record_breadcrumb(h, profile).alias("breadcrumb"),
        link_targets(h, base, profile).alias("links"),
        endpoints(h, base, profile).alias("ajax_endpoints"),
        post_arr.alias("posts"),
        frag.alias("ajax_fragment"),
        (etag if etag is not None else null).alias("etag"),
        (last_modified if last_modified is not None else null).alias("last_modified"),
    )


def content_route(content_type: Column) -> Column:
    """FLT-7: "page" for HTML responses, else "asset"."""
    return F.when(F.lower(F.coalesce(content_type, F.lit(""))).contains("html"), "page").otherwise("asset")
