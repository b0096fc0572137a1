import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pagelake.llm import alignment
from tests.llm.helpers import SF, documents, odd_documents

FOLDER = alignment.VOCABULARIES
PARTS = ["the", "Word", " ", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "don't", "1234", "é", "naïve", "日本語", "\U0001f600", "▁", " ",
         "<|endoftext|>", "<s>", "<0x41>", "á", "ﬁ", "-", "__", "\x00", "\r\n", "x" * 30, "ſ", "ю", "\x85", " ", "​"]


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers as they are, and the bytes of their tokens."""
    a = Tokenizer.from_file(f"{FOLDER}/{alignment.FILE_A}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{FOLDER}/{alignment.FILE_B}")


@pytest.fixture(scope="module")
def aligner():
    return alignment.vocabularies().aligner()


def b_bytes(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def brute_tokens(plain, text):
    """(ids, bytes) of both sides, whole text at once; none where the bytes differ."""
    a, b = plain
    if not text:
        return [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    code = alignment.letter_bytes()
    left = [(i, bytes(code[c] for c in a.id_to_token(i))) for i in x]
    right = [(i, b_bytes(b.id_to_piece(i))) for i in y]
    want = (" " + text).encode()
    same = b"".join(t for _, t in left) == want == b"".join(t for _, t in right)
    return (left, right) if same else ([], [])


def brute_groups(plain, text):
    """Groups of both sides' ids, cut where both sides' bytes so far are equally long."""
    left, right = brute_tokens(plain, text)
    groups, i, j, at_a, at_b, own = [], 0, 0, 0, 0, ([], [])
    while i < len(left) or j < len(right):
        if at_a <= at_b and i < len(left):
            own[0].append(left[i][0])
            at_a += len(left[i][1])
            i += 1
        else:
            own[1].append(right[j][0])
            at_b += len(right[j][1])
            j += 1
        if at_a == at_b:
            groups.append(own)
            own = ([], [])
    return groups


def check(spark, plain, docs):
    """All columns, from groups found one token after the other."""
    groups = [(r["doc_id"], brute_groups(plain, r["text"])) for r in docs.collect()]
    links = [[(a[-1], b[-1]) for a, b in g] for _, g in groups]
    count = Counter(p for ls in links for p in ls)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    line = lambda g: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
    want = [(d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls), sum(count[p] == highest[p[1]] for p in ls),
             sum(count[p] for p in ls), hashlib.sha256(line(g).encode()).hexdigest() if g else "") for (d, g), ls in zip(groups, links)]
    got = alignment.score_documents(docs, alignment.vocabularies())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_galloping_against_sets():
    rnd = np.random.default_rng(3)
    for n, m, top in [(0, 5, 9), (1, 1, 2), (5, 400, 500), (300, 300, 600), (40, 5000, 6000), (200, 210, 100000)]:
        for _ in range(20):
            a, b = (np.unique(rnd.integers(0, top, k)) for k in (n, m))
            at_a, at_b = alignment.common_ends(a, b)
            want = sorted(set(a.tolist()) & set(b.tolist()))
            assert a[at_a].tolist() == b[at_b].tolist() == want
    # all values of the one list behind or before those of the other
    assert len(alignment.common_ends(np.arange(5), np.arange(10, 4000))[0]) == len(alignment.common_ends(np.arange(9000, 9005), np.arange(4000))[0]) == 0


def test_cut_texts_are_encoded_as_whole_ones(aligner, plain):
    assert aligner.cuts
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 40))) for _ in range(4000)]
    for text, (a, b) in zip(texts, aligner.tokens(texts)):
        left, right = brute_tokens(plain, text)
        assert a.tolist() == [i for i, _ in left] and b.tolist() == [i for i, _ in right], text


def test_linked_pairs_are_among_the_possible_ones(aligner, plain):
    n = len(aligner.bytes_b)
    bound = aligner.length_a.sum() + aligner.length_b.sum() + n
    assert len(aligner.pairs) <= bound and (np.diff(aligner.pairs) > 0).all()
    for p in aligner.pairs[::997].tolist():
        x, y = aligner.bytes_a[p // n], aligner.bytes_b[p % n]
        assert x.endswith(y) or y.endswith(x)
    texts = ["".join(random.Random(5).choices(PARTS, k=300))]
    for a, b in aligner.tokens(texts):
        at_a, at_b = aligner.ends(a, b)
        assert (aligner.pairs[aligner.links(a, b, at_a, at_b)] == np.sort(a[at_a] * n + b[at_b])).all()


def test_forgotten_and_unremembered_parts(aligner, plain, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setattr(alignment, "JOINED", 9)
    monkeypatch.setattr(alignment, "WRITTEN", 2)
    texts = ["one two three four", "four three five six seven", "one " * 9, "z" * 200 + " one", "a▁b one", "two one one"]
    for _ in range(3):
        for text in texts:
            (a, b), = aligner.tokens([text])
            groups = brute_groups(plain, text)
            line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert aligner.digest(a, b, *aligner.ends(a, b)) == (hashlib.sha256(line.encode()).hexdigest() if groups else "")
            assert len(aligner.known) <= 3 + len(aligner.parts(text))
            assert len(aligner.known) == len(aligner.right) == len(aligner.used) == len(aligner.size[0]) == len(aligner.size[1])
    assert "one" in aligner.known


def test_query_against_one_token_after_the_other(spark, plain):
    check(spark, plain, documents(spark).select("doc_id", "text"))
    assert alignment.query(spark, SF).count() == documents(spark).count()


def test_odd_rows(spark, plain):
    check(spark, plain, odd_documents(spark))
    check(spark, plain, odd_documents(spark, [(1, "a▁b"), (2, " "), (2, " "), (None, "  x"), (3, "\x00"), (4, "日本" * 3000), (5, "word " * 9000)]))
    docs = odd_documents(spark)
    assert alignment.score_documents(docs.limit(0), alignment.vocabularies()).count() == 0
    assert alignment.score_documents(docs.where("text IS NULL"), alignment.vocabularies()).agg({"n_a": "sum"}).collect()[0][0] == 0


def test_groups_of_documents(spark, plain):
    rows = alignment.align_documents(odd_documents(spark), alignment.vocabularies()).collect()
    want = [(r["doc_id"], [([*a], [*b]) for a, b in brute_groups(plain, r["text"])]) for r in odd_documents(spark).collect()]
    assert sorted(((r["doc_id"], [(g["a"], g["b"]) for g in r["groups"]]) for r in rows), key=str) == sorted(want, key=str)
    assert all(g["start"] < g["end"] for r in rows for g in r["groups"])
