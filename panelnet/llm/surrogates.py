"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

An entity is named by its kind and a normal form (an address without regard to case, the digits of a number, the
value of an IP address, a name in lower case), so that all ways to write it share one surrogate, in every document
and on every executor, without a table of entities. The normal form's image under a keyed permutation of its format
(permutations.py) is written the way the entity was. Within a format no two entities can share a surrogate and none
keeps its own; where formats could meet, the permutation is held to images of the entity's own class (private
addresses, sound check digits, names of a pool). check_collisions() tests distinctness over a whole result.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import batch_of, discard, release, rows_of, slices, stored
from panelnet.llm.entities import GROUP, NAMES, PARTICLES, POOLS, find, luhn
from panelnet.llm.permutations import Place, low, moved, same_format

__all__ = ["NAMES", "anonymous", "check_collisions", "checked", "luhn", "replace", "replaced", "surrogate", "surrogates"]

#: Letters that are exchanged for one another, by script and kind.
ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåæèéêëìíîïòóôöõøœùúûü", "çñßýÿšžčćđł",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ",
    "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红梅建国文辉力志鹏飞波斌宇浩凯健俊帆雪琳晨辰宁欣怡佳",
)
#: First and last letters of scripts whose letters are exchanged among themselves.
RANGES = (("א", "ת"), ("ء", "غ"), ("ف", "ي"), ("क", "ह"), ("ก", "ฮ"), ("ぁ", "ん"), ("ァ", "ン"), ("가", "힣"), ("一", "龥"))
#: Networks of IPv4 whose addresses stay inside, as (first address, bits of the network).
NETWORKS = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("169.254.0.0", 16), ("100.64.0.0", 10), ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("0.0.0.0", 8), ("224.0.0.0", 3))
_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HEX = _DIGITS + "abcdef"
_LETTER = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}


class _Range:
    """The letters of a range that no alphabet has, as a sequence."""

    def __init__(self, first: str, last: str):
        self.letters = [chr(i) for i in range(ord(first), ord(last) + 1) if chr(i) not in _LETTER]
        self.place = {c: i for i, c in enumerate(self.letters)}


@lru_cache(len(RANGES))
def _range(k: int) -> _Range:
    return _Range(*RANGES[k])


def like(c: str) -> Place | None:
    """The alphabet that holds a letter or digit, and its place there; None: it stays."""
    if c in _DIGITS:
        return _DIGITS, int(c)
    found = _LETTER.get(low(c))
    if found is None and ord(c) >= 0x590:
        k = next((k for k, (a, b) in enumerate(RANGES) if a <= c <= b), None)
        if k is not None and c in _range(k).place:
            return _range(k).letters, _range(k).place[c]
    return found


def _code(c: str) -> Place | None:
    for a in (_DIGITS, _LETTERS):
        if c.lower() in a:
            return a, a.index(c.lower())
    return None


def _code_or_like(c: str) -> Place | None:
    return _code(c) or like(c)


def _hex(c: str) -> Place | None:
    return _HEX, _HEX.index(c.lower())


def _is_hex(text: str) -> bool:
    return bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", text)) and not text.isdigit()


def _address(key: bytes, name: str) -> str:
    def number(address: str) -> int:
        return int.from_bytes(bytes(map(int, address.split("."))), "big")

    def network(v: int) -> int | None:
        return next((k for k, (first, bits) in enumerate(NETWORKS) if v >> (32 - bits) == number(first) >> (32 - bits)), None)

    x = number(name)
    k = network(x)
    if k is None:
        v = moved(key, 1 << 32, x, lambda v: network(v) is None)
    else:
        free = 32 - NETWORKS[k][1]
        inside = (1 << free) - 1
        v = (x & ~inside) | moved(key + bytes([k]), 1 << free, x & inside)
    return ".".join(map(str, v.to_bytes(4, "big")))


def _digits(key: bytes, digits: str, fits=lambda s: True) -> str:
    return same_format(key, digits, like, fits)


def _phone(key: bytes, name: str) -> str:
    code, national = name.split(":")
    key += code.encode()
    if len(national) == 10 and national[3:6] == "555":
        d = _digits(key + b":555", national[:3] + national[6:], lambda s: (s[0] == "0") == (national[0] == "0"))
        return f"{code}:{d[:3]}555{d[3:]}"
    return f"{code}:" + _digits(key, national, lambda s: (s[:1] == "0") == (national[:1] == "0") and not (len(s) == 10 and s[3:6] == "555"))


def _check_digits(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(key: bytes, name: str) -> str:
    """The check digits differ from the sound ones by as much as those of the entity."""
    country, check, body = name[:2], int(name[2:4]), name[4:]
    new = same_format(key + country.encode(), body, _code)
    return f"{country}{(_check_digits(country, new) + check - _check_digits(country, body)) % 100:02d}{new}"


def _card(key: bytes, name: str) -> str:
    """The network's first digit stays; the last digit differs from the sound one by as much as that of the entity."""
    sound = next(d for d in _DIGITS if luhn(name[:-1] + d))
    new = name[0] + _digits(key + name[0].encode(), name[1:-1])
    check = next(d for d in _DIGITS if luhn(new + d))
    return new + str((int(check) + int(name[-1]) - int(sound)) % 10)


def _secret(key: bytes, name: str) -> str:
    """Each piece of hexadecimal stays hexadecimal, each other piece something else."""
    if all(_is_hex(name[i : i + 96]) for i in range(0, len(name), 96)):
        return same_format(key + b"hex", name, _hex, _is_hex)
    if name.isdigit():
        return _digits(key + b"digits", name)
    return same_format(key, name, _code, lambda s: not _is_hex(s)) if len(name) <= 96 else same_format(key + b"long", name, _code)


def _token(key: bytes, token: str) -> str:
    return _short_token(key, token) if len(token) <= 64 else _any_token(key, token)


def _any_token(key: bytes, token: str) -> str:
    if token in PARTICLES:
        return token
    if token in GROUP:
        group, at = GROUP[token]
        return low(POOLS[group][moved(key + " ".join(group).encode(), len(POOLS[group]), at)])
    if token[0] in GROUP:
        return _token(key, token[0]) + same_format(key + b"signs", token[1:], like)
    return same_format(key, token, like, lambda s: s not in GROUP and s not in PARTICLES and s[0] not in GROUP)


_short_token = lru_cache(1 << 14)(_any_token)


def surrogate(key: bytes, kind: str, name: str) -> str:
    """The normal form of the surrogate of the entity with this kind and normal form."""
    key = hmac.digest(key, kind.encode(), "sha256")
    if kind == "email":
        local, _, domain = name.rpartition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2] == "example" else 1
        own = "".join(label + "." for label in labels[:-keep])
        return same_format(key + bytes([keep]), f"{local}@{own}", _code_or_like) + ".".join(labels[-keep:])
    if kind == "person":
        return " ".join(_token(key, t) for t in name.split(" "))
    return {"ip": _address, "phone": _phone, "iban": _iban, "card": _card, "secret": _secret, "ssn": _digits}[kind](key, name)


def _made(key: bytes, kind: str, name: str) -> tuple[str, str, str]:
    """(surrogate, keyed name of the entity, keyed name of the surrogate)."""
    new = surrogate(key, kind, name)
    return new, *(hmac.digest(key, f"{kind}:{x}".encode("utf-8", "surrogatepass"), "sha256").hex()[:16] for x in (name, new))


_known = lru_cache(1 << 15)(_made)


def written(kind: str, old: str, new: str) -> str:
    """The normal form `new` in the way that `old` is written: its case, blanks and marks."""
    if kind in ("ip", "secret"):
        return new
    if kind == "person":
        out = iter(new.split(" "))
        return re.sub(r"[^\s\xa0]+", lambda m: _cased(m[0], next(out)), old)
    if kind == "email":
        return "".join(n.upper() if o != low(o) and len(n.upper()) == 1 else n for o, n in zip(old, new))
    digits = new.split(":")[-1]
    keep = sum(c.isalnum() for c in old) - len(digits)
    out, at = [], 0
    for c in old:
        if c.isalnum():
            out.append(c if at < keep else digits[at - keep])
            at += 1
        else:
            out.append(c)
    return "".join(out)


def _cased(old: str, new: str) -> str:
    if low(old) in GROUP and new in GROUP:
        group, at = GROUP[new]
        new = POOLS[group][at]
        return new.upper() if len(old) > 1 and old.isupper() else new
    return "".join(n.upper() if o != low(o) and len(n.upper()) == 1 else n for o, n in zip(old, new))


def replace(key: bytes, text: str) -> tuple[str, list[tuple[str, str, str, str]]]:
    """(the text with surrogates, [(type, keyed name of the entity, keyed name of the surrogate, surrogate)] in order)."""
    found, out, at = [], [], 0
    for e in find(text):
        new, entity_key, new_key = (_known if len(e.name) <= 128 else _made)(key, e.kind, e.name)
        shown = written(e.kind, text[e.start : e.end], new)
        out += [text[at : e.start], shown]
        at = e.end
        found.append((e.kind, entity_key, new_key, shown))
    out.append(text[at:])
    return "".join(out), found


def replaced(key: bytes, texts: list[str]) -> list[tuple[str, list]]:
    return [replace(key, t) for t in texts]


_COLUMNS = ("types", "entity_keys", "surrogate_keys", "surrogates")


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, text, n_entities, types, entity_keys, surrogate_keys, surrogates), a row for a row.

    text has the surrogates; the arrays list the entities in order of appearance, the keys naming entity and
    surrogate by a keyed hash of their normal forms. A null text stays null and has none. Null and repeated ids and
    repeated rows are handled row by row, equal texts alike; other columns are ignored; an empty table gives an empty
    result. Texts are read whole, however long, in time in proportion to their length.
    """
    strings = pa.list_(pa.string())
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), *((c, strings) for c in _COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, "doc_id", "text"):
            done = replaced(key, [t or "" for _, t in part])
            texts = [new if old is not None else None for (_, old), (new, _) in zip(part, done)]
            yield batch_of(schema, [[d for d, _ in part], texts, [len(f) for _, f in done], *([[e[k] for e in f] for _, f in done] for k in range(4))])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, text string, n_entities long, " + ", ".join(f"{c} array<string>" for c in _COLUMNS))


def check_collisions(result: DataFrame) -> DataFrame:
    """(types, what): surrogates of a result that stand for more than one entity, entities with more than one, or that stayed: none."""
    e = result.select(F.explode(F.arrays_zip("types", "entity_keys", "surrogate_keys")).alias("e")).select("e.*").distinct()
    shared = e.groupBy("types", "surrogate_keys").agg(F.count("*").alias("n")).where("n > 1").select("types", F.col("surrogate_keys").alias("what"))
    split = e.groupBy("types", "entity_keys").agg(F.count("*").alias("n")).where("n > 1").select("types", F.col("entity_keys").alias("what"))
    same = e.where("entity_keys = surrogate_keys").select("types", F.col("entity_keys").alias("what"))
    return shared.unionByName(split).unionByName(same)


def checked(docs: DataFrame, key: bytes) -> DataFrame:
    """surrogates(), written once, with a column n_collisions: how many of a row's entities check_collisions() names.

    The check covers the whole result. It reads the columns of keys alone; only their distinct rows are shuffled.
    """
    out = stored(surrogates(docs, key), "surrogates")
    bad = stored(check_collisions(out).distinct(), "collisions")
    if bad.isEmpty():
        discard(bad)
        return out.withColumn("n_collisions", F.lit(0).cast("long"))
    out = out.withColumn("_row", F.monotonically_increasing_id())
    pairs = out.select("_row", F.explode(F.arrays_zip("types", "entity_keys", "surrogate_keys")).alias("e")).select("_row", "e.*")
    hit = pairs.join(bad, (pairs.types == bad.types) & ((pairs.entity_keys == bad.what) | (pairs.surrogate_keys == bad.what)), "left_semi")
    n = hit.groupBy("_row").agg(F.count("*").alias("n_collisions"))
    return out.join(n, "_row", "left").drop("_row").withColumn("n_collisions", F.coalesce("n_collisions", F.lit(0).cast("long")))


def anonymous(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of docs with surrogates in text; other columns stay, n_chars follows the text where there is one.

    A null text stays null, an empty one empty; rows without an id or with a repeated one, and repeated rows, are
    handled row by row; an empty table gives an empty result. Long texts are taken a few at a time.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            old = batch.column("text").to_pylist()
            new = [t if o is not None else None for o, (t, _) in zip(old, replaced(key, [t or "" for t in old]))]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(new, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), old, new)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)
        release()

    return docs.mapInArrow(run, docs.schema)
