import hashlib
import random
import re

from pagelake.llm import secrets
from pagelake.llm.automaton import Pattern, compile_patterns
from tests.llm.helpers import odd_documents

HEAD = "((?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)"
PLAIN = {"assign": re.compile(HEAD + "([A-Za-z0-9+/_.=-]+)", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"),
         "hex": re.compile("[0-9a-f]+"), "temporary": re.compile("ASIA[A-Z0-9]+"), "github": re.compile("gh[pousr]_[A-Za-z0-9]+"),
         "slack": re.compile("xox[abprs]-[A-Za-z0-9-]+"), "google": re.compile("AIza[A-Za-z0-9_-]+"),
         "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
         "pem": re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----")}
LEAST = {"access": 20, "hex": 24, "temporary": 20, "github": 40, "slack": 20, "google": 39, "jwt": 30, "pem": 0}
#: The smallest table that holds secrets.
SF = "/root/testdata/sf0.01"
KINDS = [r.kind for r in secrets.RULES]
PARTS = ["password", "passwd", "Secret", "TOKEN", "api_key", "apiKEY", '"', "'", " ", ":", "=", "AKIA", "ASIA", "ABCD1234EFGH5678",
         "deadbeef", "0123456789abcdef", ".", "-", "eyJ", "eyJab", "ghp_", "xoxb-", "AIza", "A" * 20, "g", "-----BEGIN ",
         "RSA PRIVATE KEY-----", "é", "日本", "\U0001f600", "\n", "x1y2z3"]


def brute(text):
    """(start, place of the kind, end) of all matches, each rule by a search of its own."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in PLAIN[kind].finditer(text):
            if (m.end(2) - m.start(2) >= 6) if kind == "assign" else (m.end() - m.start() >= LEAST[kind]):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def scanned(scanner, text):
    data = text.encode()
    return secrets.in_code_points(data, scanner.spans(data))


def test_random_texts_against_one_search_a_rule():
    scanner, rnd = secrets.Scanner(), random.Random(7)
    found = 0
    for _ in range(8000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 25)))
        assert scanned(scanner, text) == brute(text), text
        found += len(brute(text))
    assert found > 2000


def test_matches_do_not_overlap_and_failing_ones_use_up_their_text():
    scanner = secrets.Scanner()
    for text in ["token=secret=abcdef", "token=abc password=abcdefg", "AKIA" * 6, "AKIAAKIA" + "Z" * 12 + "aAKIA" + "1" * 16,
                 "eyJa1.eyJb22222222222222222222.eyJc3.d4", "0" * 23, "0" * 24 + "g" + "f" * 30, "api_key = 'abcdef'x", "token==abcdef",
                 "apiapi_key:abcdef", "passwdpassword=abcdef", "token='' abcdef", "ſecret=abcdefg", "toKen=abcdefg"]:
        assert scanned(scanner, text) == brute(text), text


def test_long_texts_take_linear_time():
    scanner = secrets.Scanner()
    for text in ["eyJa.eyJb.c" + "d.eyJe" * 20000, "token=" + "abc" * 50000 + " ", "token" * 30000, "f" * 200000,
                 "AKIA" * 40000, "password " * 10000 + " " * 90000 + "=abcdefg"]:
        assert scanned(scanner, text) == brute(text)


def test_automaton_is_minimal_and_cut():
    same = compile_patterns([Pattern("(a|b)c*d").tree], anchored=True)
    # before, after the letter, at the end, dead
    assert same.states == 4
    auto = compile_patterns([Pattern("ab").tree, Pattern("b").tree])
    state = auto.table[auto.start + ord("a")]
    assert auto.ends[auto.table[state + ord("b")] >> 8] == (0, 1)
    assert auto.ends[auto.table[auto.cuts[0][state >> 8] + ord("b")] >> 8] == (1,)


def test_patterns_that_are_not_patterns():
    for text in ["(a", "a)", "*a"]:
        try:
            Pattern(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_odd_rows(spark):
    docs = odd_documents(spark, [(1, "token=abcdefg"), (1, "token=abcdefg"), (1, "été token=abcdefg"), (None, "AKIA" + "7" * 16), (2, None),
                                 (3, ""), (4, "é" * 4000 + "f" * 24), (5, " \t\n"), (None, None)])
    got = sorted(((r["doc_id"], [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in r["spans"]])
                  for r in secrets.scan_secrets(docs).collect()), key=str)
    assert got == sorted(((r["doc_id"], brute(r["text"] or "")) for r in docs.collect()), key=str)
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_query_against_one_search_a_rule(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = secrets.query(spark, SF).collect()
    assert len(rows) == len(texts) and any(r["n_assign"] for r in rows)
    for r in rows:
        found = brute(texts[r["doc_id"]])
        line = lambda some: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in some)
        assert r["spans"] == line(found)
        assert r["base_sha256"] == hashlib.sha256(line([f for f in found if f[1] < 3]).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in found) for j in range(3)]
