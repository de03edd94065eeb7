"""Personal data in texts: where it stands and what names it, in time that grows in proportion to the text.

Every search has an anchor that the text is scanned for once (an at sign, a digit, a run of hexadecimal, a known
word), and looks from there no further than the run that holds the anchor. Nothing passes over a text that a
pattern would match: there is no test before the search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick

from panelnet.llm.permutations import low

#: Given names by gender and script.
NAMES = {
    ("f", "latin"): "Anna Maria Emma Julia Laura Sophie Clara Helena Alice Marie Camille Elena Lucía Carmen Isabel Sofía Petra Ingrid Greta Nadine Claire Louise Amélie Jane Mary Sarah Emily Susan Linda Karen",
    ("m", "latin"): "John James Robert Michael William David Thomas Daniel Paul Mark Peter Hans Karl Stefan Jürgen Pierre Jean Louis Antoine Michel Carlos José Luis Miguel Pablo Javier Andrew George Henry Martin",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия Дарья Вера Надежда Людмила Галина",
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил Владимир Павел Юрий Олег Борис Виктор Антон",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη Δήμητρα Βασιλική",
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης Παναγιώτης Σπύρος Ανδρέας",
}
#: Family names that are no common word; a capitalised word before one makes it a person.
SURNAMES = {
    ("s", "latin"): "Smith Johnson Williams Jones Davis Wilson Anderson Thompson Robinson Roberts Evans Edwards Collins Stewart Morris Murphy O'Brien Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Dupont Durand Dubois Moreau Laurent Lefebvre García Rodríguez Martínez Hernández López González Pérez Sánchez Fernández Rossi Ferrari Esposito Nowak Kowalski Andersen Hansen Johansson Patel Singh Kumar Sharma Hussain Ahmed",
    ("e", "latin"): "Wang Zhang Liu Chen Yang Huang Zhao Zhou Zhu Guo Zheng Liang Xie Deng Feng Zeng Peng Xiao Cai Jiang Nguyen Tran Pham Tanaka Suzuki Takahashi Watanabe Yamamoto Nakamura Kobayashi",
    ("s", "han"): "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 郭 何 高 林 罗 郑 梁 谢 宋 唐 许 邓 韩 冯 曹",
    ("s", "hangul"): "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 홍",
}
#: Forms of address; they stay, so the gender that they tell stays.
TITLES = "Mr Mrs Ms Miss Herr Frau Monsieur Madame Mme Señor Señora Dr Prof Professor Г-н Г-жа Κύριος Κυρία"
#: What comes before a name; capitalised words or, in Han script, a family name and one or two signs follow.
CUES = ("my name is", "full name:", "signed by", "mein name ist", "ich heiße", "je m'appelle", "mi nombre es", "me llamo", "меня зовут", "με λένε", "我叫", "姓名：", "姓名:")
#: What comes after a name of one to four signs.
HONORIFICS = ("先生", "女士", "小姐", "太太", "老师", "さん", "様", "씨")
#: Parts of a name between given and family name.
PARTICLES = frozenset("von van der den de da di del la le dos ter zu bin al el".split())
#: Given names that are words as well; alone they are no person.
ALSO_WORDS = frozenset("mark jean miss".split())
#: Capitalised words that begin a sentence and no name.
NO_NAMES = frozenset("the a an in on at of and or but for from by to with as is was der die das und le la les el los las dear our this that".split())
#: Words that announce a secret.
SECRETS = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey")
#: Country calling codes of one and two digits; all others have three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

KINDS = ("email", "secret", "iban", "ip", "phone", "ssn", "card", "person")
GROUP = {low(n): (k, i) for pools in (NAMES, SURNAMES) for k, names in pools.items() for i, n in enumerate(names.split())}
POOLS = {k: names.split() for pools in (NAMES, SURNAMES) for k, names in pools.items()}
_TITLES = frozenset(low(t) for t in TITLES.split())


def sort_of(word: str) -> str:
    """f, m: a given name; s, e: a family name, e where it may stand first; empty: neither."""
    return GROUP[word][0][0] if word in GROUP else ""


class Entity(NamedTuple):
    """text[start:end] stands for the entity that `kind` and `name` name, whatever way it is written."""

    start: int
    end: int
    kind: str
    name: str


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


# --- electronic mail -------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[\w%+.-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def _emails(text: str) -> Iterator[Entity]:
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and _LOCAL.match(text[start - 1]) and not (text[start - 1] == "." and (start == at or text[start] == ".")):
            start -= 1
        while start < at and text[start] == ".":
            start += 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield Entity(start, m.end(), "email", low(text[start : m.end()]))
        after = m.end() if m else at + 1
        at = text.find("@", after)


# --- numbers ---------------------------------------------------------------------------------------------------

_RUN = re.compile(r"[+(0-9][0-9 ()./+-]*+")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\w))"
    r"|(?P<phone>(?<!\w)(?:\+(?:[0-9]{8,15}(?![0-9])|[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){0,4}(?:[ .-]?[0-9]{3,8})?)|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){1,3}(?:[ .-]?[0-9]{3,8})?"
    r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}"
    r"|0[1-9](?:[ .-][0-9]{2}){4}|\(0[1-9][0-9]{1,4}\) ?[0-9]{3,8}|0[1-9][0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{1,4})?|0[1-9][0-9]{8,10})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-]))"
)


#: A number has at most 15 digits; what follows them is another.
_LAST = re.compile(r"[ .-]+[0-9]+$")


def phone_parts(text: str) -> tuple[str, str]:
    """(country code, national digits) of a written number: "1" for the American form, "0" where a trunk zero leads."""
    digits = _digits(text.replace("(0)", "", 1)) if text.startswith(("+", "00")) else _digits(text)
    if text.startswith("00"):
        digits = digits[2:]
    elif not text.startswith("+"):
        return ("0", digits[1:]) if digits[0] == "0" and not re.fullmatch(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", text) else ("1", digits)
    m = re.match(r"\+([0-9]{1,3})[ .(-]", text)
    code = m[1] if m else next((digits[:k] for k in (1, 2) if digits[:k] in CALLING), digits[:3])
    return code, digits[len(code) :]


def _is_card(d: str) -> bool:
    """A number that a card network issues: its length, its first digit, and the check digit."""
    sizes = {"2": (16,), "3": (14, 15), "4": (13, 16, 19), "5": (16,), "6": (16, 17, 18, 19)}.get(d[0], ())
    return len(d) in sizes and luhn(d)


def _numbers(text: str) -> Iterator[Entity]:
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        at = run.start()
        while m := _NUMBER.search(text, at, run.end() + 2):
            kind, found = m.lastgroup, m[0]
            at = m.end()
            if kind == "ip":
                octets = [int(p) for p in found.split(".")]
                name = ".".join(map(str, octets)) if max(octets) < 256 else ""
            elif kind == "phone":
                while len(_digits(found)) > 15 and (cut := _LAST.search(found)):
                    found = found[: cut.start()]
                at = m.start() + len(found)
                name = ":".join(phone_parts(found)) if 8 <= len(_digits(found)) <= 15 else ""
            else:
                name = _digits(found)
                if kind == "card" and not _is_card(name):
                    name = ""
            if name:
                yield Entity(m.start(), at, kind, name)
            else:
                at = m.start() + 1


# --- codes -----------------------------------------------------------------------------------------------------

_HEX = re.compile(r"[0-9a-f](?<!\w.)[0-9a-f]{31,127}+(?!\w)|[0-9A-F](?<!\w.)[0-9A-F]{31,127}+(?!\w)", re.S)
_IBAN = re.compile(r"[A-Z](?<!\w.)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.S)


def _codes(text: str) -> Iterator[Entity]:
    for m in _HEX.finditer(text):
        yield Entity(m.start(), m.end(), "secret", m[0])
    for m in _IBAN.finditer(text):
        name = m[0].replace(" ", "")
        if 15 <= len(name) <= 34:
            yield Entity(m.start(), m.end(), "iban", name)


# --- words -----------------------------------------------------------------------------------------------------

_VALUE = re.compile(r"[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{16,})")
_GAP = re.compile(r"[  ](?![  ])")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_INITIAL = re.compile(r"[^\W\d_]\.")
_BEFORE = re.compile(r"(?<!\w)(?P<word>[^\W\d_]{1,40}(?:[-'’][^\W\d_]{1,40})?)[  ]$")
_HAN = re.compile(r"[一-龥]")
_SIGNS = re.compile(r"[一-龥]{1,4}$|[ァ-ヺ]{2,8}$|[가-힣]{2,4} ?$")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, words in (("name", GROUP), ("title", _TITLES), ("cue", CUES), ("honorific", HONORIFICS), ("secret", SECRETS)):
        for w in words:
            if k != "name" or len(w) > 1:
                a.add_word(w, (k, w))
    a.make_automaton()
    return a


_WORDS = _automaton()


def _capital(word: str) -> bool:
    """Whether a word of a script with case begins with a capital and is no mixture of cases."""
    return word[0].isupper() and (word[1:] == word[1:].lower() or word.isupper() or bool(re.search("['’-]", word)) or word[:2] in ("Mc", "De", "O'"))


def _edge(text: str, at: int) -> bool:
    return not (0 <= at < len(text) and (text[at].isalnum() or text[at] == "_"))


def _name_after(text: str, at: int, most: int) -> int:
    """The end of a name that begins at `at`: given names, initials and particles, then at most `most` other words."""
    end, loud = at, None
    while True:
        m = _WORD.match(text, at)
        if not m or not _edge(text, m.end()):
            return end
        word = m[0]
        if len(word) == 1 and _INITIAL.match(text, at) and word.isupper():
            at = m.end() + 1
            gap = _GAP.match(text, at)
            if not gap:
                return end
            at = gap.end()
            continue
        if word in PARTICLES:
            gap = _GAP.match(text, m.end())
            if not gap:
                return end
            at = gap.end()
            continue
        if not _capital(word) or low(word) in NO_NAMES or low(word) in _TITLES or (loud is not None and len(word) > 1 and word.isupper() != loud):
            return end
        loud = word.isupper() if len(word) > 1 else loud
        end = m.end()
        if sort_of(low(word)) not in ("f", "m"):
            most -= 1
        gap = _GAP.match(text, end)
        if not gap or not most:
            return end
        at = gap.end()


def _han_after(text: str, at: int) -> int:
    """The end of a Han name at `at`: a family name and one or two signs."""
    if at < len(text) and text[at] in POOLS["s", "han"]:
        end = at + 1
        while end < len(text) and end < at + 3 and _HAN.match(text[end]):
            end += 1
        return end if end > at + 1 else at
    return at


def _words(text: str) -> Iterator[Entity]:
    lowered = low(text)
    done = 0
    for last, (kind, word) in _WORDS.iter(lowered):
        start, end = last + 1 - len(word), last + 1
        if kind == "honorific":
            m = _SIGNS.search(text, max(0, start - 8), start)
            if m and m.start() >= done:
                first = m.start()
                signs = m[0].rstrip()
                if _HAN.match(signs) and word not in ("さん", "様"):
                    first = next((k for k in range(m.start(), start) if text[k] in POOLS["s", "han"] and start - k <= 3), start)
                if first < start:
                    done = first + len(text[first:start].rstrip())
                    yield Entity(first, done, "person", text[first:done])
            continue
        if not _edge(text, start - 1) and not _HAN.match(word):
            continue
        if kind == "secret":
            m = _VALUE.match(text, end)
            if m:
                yield Entity(m.start(1), m.end(1), "secret", m[1])
            continue
        if kind == "cue":
            at = _GAP.match(text, end)
            at = at.end() if at else end
            to = max(_name_after(text, at, 2), _han_after(text, at))
        elif not _edge(text, end) or start < done or not _capital(text[start:end]):
            continue
        elif kind == "title":
            m = re.compile(r"\.? {1,4}").match(text, end)
            at = m.end() if m else end
            to = _name_after(text, at, 2) if m else at
        else:
            at, sort = start, GROUP[word][0]
            to = _name_after(text, at, 1 if sort[0] in "fm" else 2 if sort[0] == "e" else 1)
            if sort[0] in "se":
                m = _BEFORE.search(text, max(done, start - 84), start)
                if m and _capital(m["word"]) and len(m["word"]) > 1 and low(m["word"]) not in NO_NAMES and low(m["word"]) not in _TITLES:
                    at, to = m.start("word"), end
                elif sort[0] == "s" or to <= end:
                    continue
            elif to <= end and word in ALSO_WORDS:
                continue
        if to > at and at >= done:
            done = to
            yield Entity(at, to, "person", " ".join(low(text[at:to]).replace(" ", " ").split()))


def find(text: str) -> list[Entity]:
    """The entities of a text in order, none inside another: the first wins, and of those at one place by KINDS."""
    found = [*_emails(text), *_numbers(text), *_codes(text), *_words(text)]
    found.sort(key=lambda e: (e.start, KINDS.index(e.kind), -e.end))
    out, at = [], 0
    for e in found:
        if e.start >= at:
            out.append(e)
            at = e.end
    return out
