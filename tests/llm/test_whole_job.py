"""Cases that an operator once left out: each failed before the whole job was done."""

from panelnet.llm import cotraining, near_dup, surrogates, toxicity


def test_surrogates_shortcut_lets_nothing_through():
    texts = [
        "“Anna Weber” came", "«Marie Dupont»", "„Mrs Smith“", "then—Anna Weber", "by Anna Weber", "„Иван Петров“",
        'password = "CorrectHorseBatteryStaple"', "api_key=AbCdEfGhIjKlMnOpQrSt", "Access-Key: AbCdEfGhIjKlMnOpQrSt", "PASSWD=abcdefghijklmnopqrst", "toKen=abcdefghijklmnopqrst",
        "id " + "abcdef" * 6, "id " + "ABCDEF" * 6, "met Anna Weber", "x_Anna Weber", "nothing here", "",
    ]
    got = surrogates.replaced(b"k", texts)
    assert got == [surrogates.replace(b"k", t) for t in texts]
    assert [bool(found) for _, found in got] == [True] * 14 + [False] * 3


def _labelled(spark):
    docs = spark.createDataFrame([(i, ("vile hateful scum " if i % 2 else "kind gentle day ") * 3 + f"w{i}", "web", "en") for i in range(400)], "doc_id long, text string, source string, lang string")
    return docs, spark.createDataFrame([(i, i % 2, i % 2) for i in range(40_000)], "doc_id long, toxic int, quality int")


def test_toxicity_sample_is_taken_from_the_documents_at_hand(spark):
    docs, labels = _labelled(spark)
    few = toxicity.train(docs, labels, most=200)
    assert (few == toxicity.train(docs, labels.where("doc_id < 400"), most=200)).all() and few.any()
    assert toxicity.not_toxic(docs, few).count() == 200


def test_toxicity_without_labels_keeps_every_row(spark):
    docs, labels = _labelled(spark)
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert toxicity.not_toxic(docs, toxicity.train(docs, none)).count() == 400


def test_cotraining_sample_is_taken_from_the_documents_at_hand(spark):
    docs, labels = _labelled(spark)
    few = cotraining.train(docs, labels, ["source", "lang"], (200, 100))
    same = cotraining.train(docs, labels.where("doc_id < 400"), ["source", "lang"], (200, 100))
    assert (few.text == same.text).all() and (few.meta == same.meta).all() and few.text.any()


def test_near_dedup_rows_without_and_with_repeated_ids(spark):
    def words(seed):
        return [f"{seed}w{i}" for i in range(80)]

    def near(seed):
        return " ".join([*words(seed)[:-1], "other"])

    a, b, c, d, e, f = (" ".join(words(s)) for s in "abcdef")
    rows = [
        (1, a), (None, a), (None, b), (None, c), (None, c), (None, near("c")), (None, None), (None, None), (None, ""),
        (2, d), (2, d), (2, e), (2, None), (3, near("d")), (4, f), (5, f), (None, near("a")),
    ]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int").repartition(4)
    got = near_dup.one_of_each(docs).collect()
    kept = sorted(((r.doc_id, r.text) for r in got), key=str)
    some_c = [x for x in kept if x in ((None, c), (None, near("c")))]
    assert len(some_c) == 1
    want = [(1, a), (None, b), (None, None), (None, None), (None, ""), (2, d), (2, e), (2, None), (4, f), *some_c]
    assert kept == sorted(want, key=str)
    assert len({r.row for r in got}) == len(got)
