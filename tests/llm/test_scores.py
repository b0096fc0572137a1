import math
import re
import zlib

from pagelake.llm import classifier, licenses, quality
from tests.llm.helpers import SF, documents, odd_documents, words

LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def license_words(text):
    return LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base_places(text):
    ws = license_words(text)
    return sorted((i, label) for label, p in PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p)] == p)


def check_licenses(rows, docs):
    want = sorted(((r["doc_id"], len(license_words(r["text"])), base_places(r["text"])) for r in docs), key=str)
    got = sorted(((r["doc_id"], r["n_words"], sorted((m["start"], m["label"]) for m in r["matches"] if m["phrase"]))
                  for r in rows), key=str)
    assert got == want


def test_all_places_of_phrases(spark):
    docs = documents(spark)
    check_licenses(licenses.scan_licenses(docs).collect(), docs.collect())


def test_license_odd_rows(spark):
    texts = ["MIT License", "mit-license MIT\nLICENSE apache mit license", "The Apache  License, General Public", "general public license " * 400,
             "Licence MIT", "émit license", "mit", None, "", "GNU GENERAL PUBLIC LICENSE, Version 3", "license mit license license mit"]
    docs = odd_documents(spark, list(enumerate(texts)))
    rows = licenses.scan_licenses(docs).collect()
    check_licenses(rows, docs.collect())
    check_licenses(licenses.scan_licenses(odd_documents(spark)).collect(), odd_documents(spark).collect())
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_notices_need_their_key_phrases(spark):
    texts = ["x Licensed under the Apache License, Version 2.0. y", "Licensed under an Apache License, Version 2.0",
             "Licensed under the Apache License, Version 1.0", "Permission is hereby granted, free of charge, to any person obtaining a "
             "copy of this program and associated documentation files", "Licensed under CC BY-NC 4.0."]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    labels = {r["doc_id"]: {m["label"] for m in r["matches"] if not m["phrase"]} for r in rows}
    assert labels == {0: {"apache-2.0"}, 1: {"apache-2.0"}, 2: set(), 3: {"mit-text"}, 4: {"cc-by-nc-4.0"}}


def test_notices_that_lack_their_rarest_words():
    """Any words replaced in place, up to what the coverage allows, while they stand elsewhere in the file."""
    for t, template in enumerate(licenses.NOTICES):
        ws = licenses.words_of(template.text.encode())
        idf = {w: float(len(ws) - i) for i, w in enumerate(reversed(ws))}
        index = licenses.Index(licenses.NOTICES, idf)
        keys = {w for k in index.keys[t] for w in k}
        free = sorted((i for i, w in enumerate(ws) if w not in keys), key=lambda i: -idf[ws[i]])
        gone = free[:int(0.3 * len(ws) + 1e-9)]
        text = [b"zz" if i in gone else w for i, w in enumerate(ws)] + [b"filler"] * 30 + [ws[i] for i in gone]
        assert any((u, at) == (t, 0) for u, at, _ in index.places(text)), template.label


def test_license_query_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    for r in licenses.query(spark, SF).collect():
        places = base_places(texts[r["doc_id"]])
        starts = [i for i, _ in places]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def counted(text):
    ws, text = words(text), text or ""
    where = {}
    for i in range(len(ws) - 7):
        where.setdefault(tuple(ws[i:i + 8]), []).append(i)
    repeat = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))


def check_quality(rows, docs):
    got, want = [], []
    for r in rows:
        got.append((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]))
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= quality.THRESHOLD)
    for r in docs:
        want.append((r["doc_id"], *counted(r["text"])))
    assert sorted(got, key=str) == sorted(want, key=str)


def labels(spark, sf=SF):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_counts_and_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.query(spark, sf).collect()
    check_quality(rows, docs.collect())
    good = {r["doc_id"]: r["quality"] for r in labels(spark, sf).collect()}
    clean = [r for r in rows if good.get(r["doc_id"]) == 1 and not r["base_failed"]]
    junk = [r for r in rows if good.get(r["doc_id"]) == 0]
    assert all(r["kept"] for r in clean) and sum(r["kept"] for r in junk) <= 0.2 * len(junk)


def test_quality_ratio_is_that_of_the_counts(spark):
    import math
    texts = [(1, "a b a"), (2, "a c"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = quality.judge_quality(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()
    grams = lambda t: [(w,) for w in words(t)] + list(zip(words(t), words(t)[1:], strict=False))
    raw, good = [g for _, t in texts for g in grams(t)], grams("a b a")
    b = quality.BUCKETS
    for r, (_, t) in zip(sorted(rows, key=lambda r: r["doc_id"]), texts, strict=True):
        llr = [math.log((good.count(g) + 1) / (len(good) + b)) - math.log((raw.count(g) + 1) / (len(raw) + b)) for g in grams(t)]
        assert abs(r["llr"] - sum(llr) / max(1, len(llr))) < 1e-3


def test_quality_odd_rows(spark):
    docs = odd_documents(spark)
    odd_labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (None, 1, 0), (2, None, None), (77, 1, 0)],
                                       "doc_id long, quality int, toxic int")
    check_quality(quality.judge_quality(docs, quality.trusted_ids(odd_labels)).collect(), docs.collect())
    rows = quality.judge_quality(docs, quality.trusted_ids(odd_labels.limit(0))).collect()
    assert all(r["llr"] == 0 for r in rows)
    assert quality.judge_quality(docs.limit(0), quality.trusted_ids(odd_labels)).count() == 0


def test_every_trusted_document_is_counted(spark):
    """Many of them, by a broadcast and by an exchange."""
    n = 20_500
    docs = spark.range(2 * n).selectExpr("id AS doc_id", "CASE WHEN id < %d THEN 'good' ELSE 'raw' END AS text" % n)
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    trusted = quality.trusted_ids(labels)
    assert trusted.count() == n
    broadcast = quality.log_ratios(docs, trusted)
    b = quality.BUCKETS
    good = spark.sql(f"SELECT pmod(xxhash64('good'), {b}) AS b").first()["b"]
    assert broadcast[good] == round(math.log((n + 1) / (n + b)) - math.log((n + 1) / (2 * n + b)), 4)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert quality.log_ratios(docs, trusted) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = classifier.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["score"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    pairs = [(g > b) + 0.5 * (g == b) for g, x in held if x == 1 for b, y in held if y == 0]
    assert sum(pairs) / len(pairs) > 0.97


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, marks = documents(spark), labels(spark)
    other = marks.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    changed = docs.selectExpr("doc_id", "text", "n_chars", "'xx' AS lang", "'yy' AS source")
    one = classifier.score_documents(docs, classifier.train(docs, marks)).collect()
    two = classifier.score_documents(changed, classifier.train(changed, other)).collect()
    assert {r["doc_id"]: r["score"] for r in one} == {r["doc_id"]: r["score"] for r in two}


def test_machine_sums_pairs():
    import numpy as np
    rng = np.random.default_rng(0)
    feats = [classifier.features(t, None) for t in (b"a b c a", b"", b"x y")]
    m = classifier.fit(feats, np.array([1, 0, 1], np.float32))
    m.v[:] = rng.normal(size=m.v.shape)
    for row, feat in enumerate(feats):
        slots, values, _ = m.rows([feat])
        y = m.w0 + (m.w[slots] * values).sum()
        for i in range(len(slots)):
            for j in range(i):
                y += values[i] * values[j] * (m.v[slots[i]] @ m.v[slots[j]])
        assert abs(m.scores(feats)[row] - 1 / (1 + np.exp(-y))) < 1e-4


def test_classifier_odd_rows(spark):
    docs = odd_documents(spark)
    some = spark.createDataFrame([(1, 1), (2, 0), (6, None), (None, 1), (9, 0), (1, 1)], "doc_id long, quality int")
    for marks in (some, some.limit(0)):
        rows = classifier.score_documents(docs, classifier.train(docs, marks)).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert rows[0]["h"] == "d"
    assert all(r["score"] == 0.5 for r in rows)
    assert classifier.score_documents(docs.limit(0), classifier.train(docs, some)).count() == 0


def test_one_training_row_an_id(spark):
    """An id with thousands of rows, equal and different ones, counts once."""
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    hot = spark.range(20_000).selectExpr(f"{ids[0]}L AS doc_id", "concat('text ', id % 7) AS text", "6L AS n_chars")
    docs = hot.unionByName(spark.createDataFrame([(i, f"document {i}", 11) for i in ids[1:]], "doc_id long, text string, n_chars long"))
    labels = spark.createDataFrame([(i, i % 2) for i in [*ids, ids[0]]], "doc_id long, quality int")
    feats, marks = classifier.training_rows(docs, labels)
    assert len(feats) == len(marks) == len(ids)
    assert len(classifier.training_rows(docs, labels, most=5)[0]) == 5
