"""License scans: normalised sentences -> known licence sentences -> ordered licence rules, in Spark expressions only.

A text is cut into sentences twice: by its lines, and with wrapped lines joined, comment leaders and list marks gone.
The joined form reads notices that are broken over lines; the other one reads notices that stand on a line of their
own under text that does not end in a mark. Rules are sequences of identifiers; at each place the longest one that
matches wins, and what it matches is not read again.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import as_text
from panelnet.llm.license_texts import MORE_TAGS, NAMES, NOTICES

#: Patterns that Java, Python and RE2 read alike. A text has a line feed before and after it when they are applied.
_LEADER = r"(?://+|/\*+|\*+/?|#+!?|;+|--+|%+|<!--+)"
_ITEM = r"\(?(?:[0-9]{1,2}|[a-zA-Z]|[ivx]{1,4})[.)]"
STEPS_JOINED = (
    (r"[ \t\r]*(?:\*+/|--+>)?[ \t\r]*\n", "\n"),
    (rf"\n[ \t]*(?:{_LEADER}[ \t]*)?(?:{_ITEM}[ \t]+)?", "\n"),
    (r"(?i)\n((?:copyright[ \t,:]*(?:\(c\)|©|[0-9]{4}|by )|\(c\)|©|spdx-license-identifier|all rights reserved)[^\n]*)", "\n\n$1\n\n"),
    (r"\n\n+", "\u0001"),
    (r"\n", " "),
)
STEPS_LINES = ((r"[ \t\r]*\n[ \t]*", "\u0001"), (rf"\x01(?:{_LEADER}[ \t]*)(?:{_ITEM}[ \t]+)?", "\u0001"))
#: A tag's colon ends no sentence, a plus sign there means later versions, and each operand is a tag of its own.
_TAG = r"(?i)(spdx-license-identifier):?[ \t]*\(?"
STEPS_TAGS = (
    (r"(?i)(free software):", "$1;"),
    (r"(?i)\bv\.[ \t]*([0-9])", "v$1"),
    (_TAG, "$1 "),
    (r"(?i)(spdx-license-identifier [^\n]*?[0-9])\+", "$1-or-later"),
    *((r"(?i)(spdx-license-identifier [^\n ]+)\)?[ \t]+(?:or|and|with)[ \t]+\(?", "$1\n\nSPDX-License-Identifier "),) * 4,
)
STEPS_ENDS = ((r"([.:!?][\"')\]]*)[ \t]+(?:" + _ITEM + r"[ \t]+)?", "$1\u0001"),)
STEPS_SENTENCE = (
    (r"[^a-z0-9]+", " "),
    (r"^ | $", ""),
    (r"^(?:(?:this|the) [a-z]+(?: [a-z]+)? (?:is|are) |it is |code )?(?:free software )?(?:dual |jointly )?(?:licensed|released|distributed|available|published|provided|made available|licenced) (?:to you )?under (?:the )?(?:terms of (?:the )?)?", "under "),
)
#: Every known sentence has one of these; a text with none is not split at all.
TRIGGERS = ("licen", "permission", "copyright", "redistribut", "warrant", "liable", "public domain", "spdx", "apache.org", "mpl", "this notice", "gnu ", "gpl", "cc by", "cc0", "dedication", "unported", "vim ", "cecill", "eupl", "advertising", "anyone is free")


def _python(steps, text: str) -> str:
    for pattern, new in steps:
        text = re.sub(pattern, re.sub(r"\$([0-9])", r"\\\1", new), text)
    return text


def _normal(sentence: str) -> str:
    return _python(STEPS_SENTENCE, sentence.lower())


def _parts(text: str) -> list[str]:
    """The normalised sentences of a wording, cut as a text is."""
    joined = _python(STEPS_ENDS, _python(STEPS_JOINED, _python(STEPS_TAGS, f"\n{text}\n")))
    return [s for s in map(_normal, joined.split("\u0001")) if s]


def _tables() -> tuple[dict[str, str], dict[tuple[str, ...], str]]:
    """({sentence: identifier}, {sequence of identifiers: licence}) from the wordings."""
    known: dict[str, str] = {}
    rules: dict[tuple[str, ...], str] = {}

    def rule(licence: str, ids: list[str]) -> None:
        if rules.setdefault(tuple(ids), licence) != licence:
            raise ValueError(f"two licences have the rule {ids}")

    def identified(stem: str, text: str) -> list[str]:
        return [known.setdefault(s, f"{stem}.{len(known)}") for s in _parts(text)]

    for licence, stem, wording in NOTICES:
        parts = [(w.startswith("?"), identified(stem, w.removeprefix("?"))) for w in wording]
        for held in itertools.product(*([True, False] if optional else [True] for optional, _ in parts)):
            rule(licence, [i for h, (_, ids) in zip(held, parts) for i in ids if h])
    for licence, names in NAMES.items():
        for name in names.split("; "):
            rule(licence, identified(f"name.{licence}", f"Licensed under the {name}."))
    for licence in (*NAMES, *MORE_TAGS):
        rule(licence, identified(f"tag.{licence}", f"SPDX-License-Identifier {licence}"))
    return known, rules


KNOWN, RULES = _tables()
if bad := [s for s in KNOWN if not any(t in s for t in TRIGGERS)]:
    raise ValueError(f"licence sentences without a trigger: {bad}")


def _replaced(c: Column, steps) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(new))
    return c


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(_replaced(text, STEPS_ENDS), "\u0001"), lambda s: _replaced(F.lower(s), STEPS_SENTENCE)), lambda s: s != "")


def joined_sentences(text: Column) -> Column:
    """Normalised sentences of a text whose wrapped lines are joined; blank lines and notices of one line end them."""
    return _sentences(_replaced(text, STEPS_JOINED))


def line_sentences(text: Column) -> Column:
    """Normalised sentences of a text in which every line feed ends one."""
    return _sentences(_replaced(text, STEPS_LINES))


def identifiers(sentences: Column) -> Column:
    """Each sentence's identifier, "" where it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.transform(sentences, lambda s: F.when(s.isin(list(KNOWN)), F.element_at(table, s)).otherwise(F.lit("")))


def recognise(ids: Column) -> Column:
    """The licences of rules that match runs of the sequence, from the left, the longest first."""
    line = F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">"))
    runs = sorted(("".join(f"<{i}>" for i in rule), licence) for rule, licence in RULES.items())
    pattern = "|".join(re.escape(r) for r, _ in sorted(runs, key=lambda x: -x[0].count("<")))
    table = F.create_map(*[F.lit(x) for pair in runs for x in pair])
    return F.transform(F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(1)), lambda r: F.element_at(table, r))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, sentence_ids, n_sentences, licenses), a row for a row.

    sentence_ids are the known sentences in their order, of the joined form unless the lines have more; n_sentences
    counts them; licenses are the distinct SPDX names that either form shows, sorted. A null or empty text has none.
    Null and repeated ids and repeated rows are scanned row by row, equal texts alike; other columns are ignored; an
    empty table gives an empty result. Texts are read whole, however long: only one with a word that notices use is split.
    """
    none = F.array().cast("array<string>")
    d = docs.select("doc_id", as_text().alias("_t"))
    some = F.col("_t").rlike("(?i)" + "|".join(re.escape(t) for t in TRIGGERS))
    d = d.select("doc_id", F.when(some, _replaced(F.concat(F.lit("\n"), "_t", F.lit("\n")), STEPS_TAGS)).alias("_t"))
    d = d.select("doc_id", *(F.when(F.col("_t").isNotNull(), identifiers(f(F.col("_t")))).otherwise(none).alias(n) for n, f in (("_j", joined_sentences), ("_l", line_sentences))))
    held = {c: F.filter(c, lambda x: x != "") for c in ("_j", "_l")}
    d = d.select("doc_id", "_j", "_l", F.when(F.size(held["_l"]) > F.size(held["_j"]), held["_l"]).otherwise(held["_j"]).alias("sentence_ids"))
    found = F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(F.concat(recognise(F.col("_j")), recognise(F.col("_l")))))).otherwise(none)
    return d.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join(found, ",").alias("licenses"))
