"""Surrogates against a plain search, one-to-one maps, forms of one entity, and time on long runs."""

import hashlib
import random
import re
import time

import pytest

import corpus_pipeline
from panelnet.llm import entities, permutations, queries, surrogates

MID, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
KEY = b"k"


def _news(text):
    return [n for *_, n in surrogates.replace(KEY, text)[1]]


def test_kinds_and_traits():
    text = (
        "Mail anna.b7@mail3.example.com or Anna.B7@mail3.example.com, call +1 (017) 555-7713, ip 10.1.2.3 and 8.8.4.4, card 4111111111111111, "
        "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\", ssn 123-45-6789. Mrs Maria Weber met Иван Петров. Version 1.2.3 of 2024-01-02 stays, and 1234567890123456."
    )
    out, found = surrogates.replace(KEY, text)
    assert [k for k, *_ in found] == ["email", "email", "phone", "ip", "ip", "card", "secret", "ssn", "person", "person"]
    assert "Version 1.2.3 of 2024-01-02 stays, and 1234567890123456." in out and "Mrs " in out
    new = _news(text)
    assert new[0].lower() == new[1].lower() and new[0] != new[1] and new[0].endswith(".example.com")
    assert new[2].startswith("+1 (") and "555-" in new[2] and new[3].startswith("10.") and surrogates.luhn(new[5]) and new[5][0] == "4"
    assert re.fullmatch("[0-9a-f]{40}", new[6]) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", new[7])
    assert new[8].split()[0] in surrogates.NAMES["f", "latin"].split() and new[9].split()[0] in surrogates.NAMES["m", "cyrillic"].split()
    assert not set(new) & set(re.split("[ ,\"]+", text)) and surrogates.replace(b"other", text)[0] != out


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("+1 (017) 555-7713", "017-555-7713"), ("+1 (017) 555-7713", "(017) 555-7713"), ("+49 171 2345678", "+491712345678"), ("+49 171 2345678", "0049 171 2345678"),
        ("0171 2345678", "(0171) 2345678"), ("4111111111111111", "4111-1111-1111-1111"), ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00"), ("8.8.4.4", "08.8.4.4"),
        ("X.Y@Foo.org", "x.y@foo.ORG"), ("JOHN SMITH", "John Smith"),
    ],
)
def test_forms_of_one_entity_agree(a, b):
    (_, ka, na, ta), (_, kb, nb, tb) = (surrogates.replace(KEY, f"see {x} now")[1][0] for x in (a, b))
    assert (ka, na) == (kb, nb) and ka != na
    plain = [re.sub("[^a-z0-9]", "", x.lower()) for x in (ta, tb)]
    assert plain[0].endswith(plain[1][-7:])


@pytest.mark.parametrize(
    "text",
    [
        "password = correcthorsebatterystaple", "“Anna Schmidt” said", "JOHN SMITH", "met Wei Chen today", "Chen Wei", "0171 2345678", "017112345678", "01 23 45 67 89", "my name is Bob Quark",
        "我叫李伟。", "王小明先生", "田中さん", "김민수씨", "Mr. O'Toole", "Dr. Müller-Lüdenscheidt", "Petra", "Anna von Hohenstein", "Íñigo@example.com", "..a@b.org", "x" * 300 + "@b.org",
    ],
)
def test_what_is_found(text):
    out, found = surrogates.replace(KEY, text)
    assert len(found) == 1 and out != text and found[0][1] != found[0][2]


@pytest.mark.parametrize("text", ["", "The Smith of old", "Mark the line", "1.2.3.4.5", "2024-01-02 12:30", "1234 5678", "a@b", "@", "a.@b.com", "300.1.1.1", "4111111111111112", "1700000000000", "X_Anna Weber".lower(), "Dr", "10, 20, 30"])
def test_what_is_not(text):
    assert surrogates.replace(KEY, text) == (text, [])


def test_plain_search_finds_the_same():
    """Runs of pieces, searched again with a pattern from every character."""
    r = random.Random(5)
    pieces = ["a", ".", "@", "b.org", "x.y", " ", " ", "10.0.0.1", "255.255.255.255", "999.1.1.1", "-", "_", "é", "123-45-6789", "ab" * 16, "AB" * 20, "\n", "1", "+"]
    plain = {
        "email": re.compile(r"(?<![\w%+-])(?<![\w%+-]\.)[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
        "ip": re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\w)"),
        "secret": re.compile(r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)"),
        "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    }
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 14)))
        want, at = [], 0
        spans = [(m.start(), entities.KINDS.index(k), m.end()) for k, p in plain.items() for m in p.finditer(text) if k != "ip" or max(map(int, m[0].split("."))) < 256]
        for s, k, e in sorted(spans):
            if s >= at:
                want.append((s, e, entities.KINDS[k]))
                at = e
        got = [x[:3] for x in entities.find(text)]
        if any(kind not in plain for *_, kind in got):  # a plus sign before an address makes it a number to call
            continue
        assert got == want, text


def test_permutations_have_one_cycle():
    for n in (2, 3, 10, 97, 1000):
        seen, x = set(), 0
        while x not in seen:
            seen.add(x)
            x = permutations.moved(KEY, n, x)
        assert len(seen) == n and x == 0
    odd = {x: permutations.moved(KEY, 99, x, lambda v: v % 2 == 1) for x in range(1, 99, 2)}
    assert sorted(odd.values()) == sorted(odd) and all(a != b for a, b in odd.items())


def _distinct(kind, names):
    new = [surrogates.surrogate(KEY, kind, n) for n in names]
    assert len(set(new)) == len(names) and not any(a == b for a, b in zip(names, new))
    return new


def test_maps_are_one_to_one():
    _distinct("ssn", [f"{i:09d}" for i in range(1000)])
    assert all(surrogates.luhn(n) == surrogates.luhn(o) for o, n in zip([f"4{i:012d}" for i in range(3000)], _distinct("card", [f"4{i:012d}" for i in range(3000)])))
    _distinct("iban", [f"DE{i:02d}370400440532013000" for i in range(100)])
    _distinct("ip", [f"{a}.{b}.0.1" for a in (8, 9, 10, 127, 172, 192, 224, 255) for b in range(0, 256, 5)])
    for names in [*entities.NAMES.values(), *entities.SURNAMES.values()]:
        low = [n.lower() for n in names.split()]
        assert sorted(_distinct("person", low)) == sorted(low)
    _distinct("person", [f"q{a}{b}" for a in "aeiou" for b in "bcdfg"])
    _distinct("phone", [f"1:{i:010d}" for i in range(2_120_000_000, 2_130_000_000, 7_001)] + [f"1:{i:03d}555{i:04d}" for i in range(500)])
    _distinct("email", [f"{a}{b}@x{c}.example.com" for a in "abc" for b in "0123" for c in "ab"])
    _distinct("secret", [hashlib.md5(bytes([i])).hexdigest() for i in range(250)] + ["Ab" * 8, "aB" * 8, "ab" * 8 + "z", "1" * 32])


@pytest.mark.parametrize("run", ["a1", "1", "a.", "A-", "a@", "Mr ", "Anna J. ", "token=", "(", "DE89 ", "1.1.", "+1 ", "王", "Anna-", "x@y."])
def test_time_grows_with_the_length_of_a_run(run):
    text = (run * 1_000_000)[:1_000_000]
    start = time.process_time()
    surrogates.replace(KEY, text + "1")
    assert time.process_time() - start < 8


def test_over_the_table(spark):
    out = queries.op2_pii_surrogates(spark, MID).persist()
    assert surrogates.check_collisions(out).count() == 0 and out.where("n_collisions <> 0").count() == 0
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    entity = {}
    for r in out.collect():
        assert (r.text, [tuple(x) for x in zip(r.types, r.entity_keys, r.surrogate_keys, r.surrogates)]) == surrogates.replace(queries.SURROGATE_KEY, old[r.doc_id])
        for m in re.findall(r"\S+@\S+\.com|\d+\.\d+\.\d+\.\d+|555-\d{4}|[0-9a-f]{40}|(?<!\d)\d{16}(?!\d)", old[r.doc_id]):
            assert m not in r.text or re.fullmatch(r"\d{16}", m) and not surrogates.luhn(m)
        for k, a, b in zip(r.types, r.entity_keys, r.surrogate_keys):
            assert entity.setdefault((k, a), b) == b
    assert len({(k, b) for (k, _), b in entity.items()}) == len(entity) > 50


def test_collisions_are_named(spark):
    rows = [(1, ["ip", "ip"], ["a", "b"], ["c", "c"]), (2, ["ip"], ["d"], ["d"]), (3, ["ip", "card"], ["e", "a"], ["f", "f"]), (4, [], [], [])]
    bad = surrogates.check_collisions(spark.createDataFrame(rows, "doc_id long, types array<string>, entity_keys array<string>, surrogate_keys array<string>"))
    assert sorted(map(tuple, bad.collect())) == [("ip", "c"), ("ip", "d")]


def test_the_stage_is_the_operator(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.doc_id: surrogates.replace(queries.SURROGATE_KEY, r.text)[0] for r in docs.collect()}
    assert {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["pii"](spark, docs, SMALL).collect()} == want
