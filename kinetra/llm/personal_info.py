"""Personal information inside free text."""

from __future__ import annotations

import functools
import logging
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators.common import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join, size_of_row, written

KINDS = ("email", "phone", "id_number", "address", "name")
#: Scoring goes on until no item changes, at most so many rounds (then a warning is logged); how often an item must lie in sure contexts.
MOST_ROUNDS, SEEN = 40, 2
SHARE = {"number": 0.1, "address": 0.1, "name": 0.12, "email": 0.1}
#: What share of the contexts in which a word stands as a street's must be sure: one of three is not enough.
STREET_SHARE = 0.4
#: How many given names a family name of one sign must be seen with; a sign of a fixed word has few.
PARTNERS = 4
#: Last letters of a name by which others of its kind are known: how many letters, how many names, what share of all words with them.
ENDING, ENDING_NAMES, ENDING_SHARE = 5, 3, 0.5
#: How sure a context must be. A number is up to four candidates (with and without letters around), and few formats are seeds.
SURE = {"number": 0.12, "address": 0.3, "name": 0.5, "email": 0.3}
#: From here a context alone makes an instance.
ALONE_SURE, ALONE_SEEN = 0.75, 5

# Words that make addresses and names of the six languages.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "herr", "frau", "mme", "m.", "sr", "sra", "дк", "г-н", "г-жа"}
HONORIFICS = ("先生", "様", "氏")
PARTICLE = r"(?:van der|van den|van|von der|von|zu|de la|de los|del|de|du|da|di|la|le)"
_U, _L = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё'’̀-ͯ"
_CAP = rf"[{_U}][{_L}{_U}]+"
_TAIL = rf"(?:, (?:\d{{5}} )?{_CAP}(?:-{_CAP})?(?: (?i:del|de la|an der|am|sur) {_CAP})?(?: [A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}})?)?"
_NUM = r"\d{1,4}(?:[a-zа-я]|[A-Z](?![A-Za-z]))?"
#: Forms of street addresses. What stands in ``key`` (any word) decides whether one is an address: words are learnt, few are seeds.
ADDRESSES = {
    "en": rf"(?:(?i:Flat|Apt|Apartment|Unit|Suite) \d+[a-z]?, )?{_NUM} {_CAP} (?P<key>{_CAP})(?![{_U}{_L}])\.?(?:, (?i:Apt|Flat|Unit) \d+[a-z]?)?{_TAIL}",
    "en_long": rf"(?:(?i:Flat|Apt|Apartment|Unit|Suite) \d+[a-z]?, )?{_NUM} (?:[{_U}]\.|{_CAP}) {_CAP} (?P<key>{_CAP})(?![{_U}{_L}])\.?(?:, (?i:Apt|Flat|Unit) \d+[a-z]?)?{_TAIL}",
    "end": rf"(?:(?i:Am|Im|An der) )?(?P<end>{_CAP}\.?) {_NUM}{_TAIL}",
    "fr": rf"{_NUM}(?: (?i:bis|ter))?,? (?P<key>(?:[{_L}]{{2,}}|[{_U}]{{2,}}(?![{_L}]))\.?) (?:(?i:du|de la|des|de) |(?i:de l'|d'))?{_CAP}{_TAIL}",
    "first": rf"(?P<key>(?i:An der)|[{_U}]/|{_CAP}\.?) (?:(?i:del|de la|de los|de) )?{_CAP}(?: {_CAP})?,? (?:(?i:n)\.º )?{_NUM}(?:, \d+\.º [A-Z])?{_TAIL}",
    "ru": rf"(?:(?i:г)\. {_CAP}(?:-{_CAP})?, )?(?P<key>[А-Яа-яЁё]+\.?) {_CAP}(?: {_CAP})?, (?:(?i:д\.|дом) )?{_NUM}(?:, (?i:кв)\. \d+)?",
    "ja": r"(?:[一-鿿々]{1,4}[県都府道])?[一-鿿々]{1,5}?[市区町村][一-鿿々]{0,6}(?P<key>\d+丁目\d+番\d+号|\d+-\d+-\d+)",
}
#: Lengths of the ends of a word by which it is known as a street's (one word in some languages).
_ENDS = (3, 5)
_LONG = "\0"
_AT = r"(?P<at> ?@ ?| ?[(\[]at[)\]] ?)"
_DOT = r"(?:\.| ?[(\[]dot[)\]] ?)"
_DOTS = re.compile(_DOT, re.I)
EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*)(?:{_DOT}[A-Za-z][A-Za-z0-9-]*)+"
_EDGE = r"(?<![A-Za-z0-9А-Яа-яЁё_])"
_SEP = r"(?:[ ]{1,3}|[.\-/])"
NUMBERS = (
    rf"{_EDGE}(?P<plus>\+\d{{1,3}}(?:{_SEP}?\(\d{{1,4}}\))?(?:{_SEP}?\d{{1,8}})+)",
    rf"{_EDGE}(?P<eight>\d \(\d{{3}}\) ?\d{{3}}[ -]?\d{{2}}[ -]?\d{{2}}|\d\(\d{{3}}\) ?\d{{3}}[ -]?\d{{2}}[ -]?\d{{2}})",
    rf"(?P<paren>\(\+?\d{{2,4}}\) ?\d{{2,10}}(?:{_SEP}\d{{2,6}})*)",
    rf"{_EDGE}(?P<lead>[A-Z]{{1,2}}[ -]?)?(?P<core>\d+(?:[A-Z]{{1,2}}\d+)*(?:{_SEP}\d+)*)(?P<tail>[ -]?[A-Z](?: \d{{3}})?(?![A-Za-z0-9]))?(?P<ext> ext\.? ?\d+)?",
)
NAMES = (
    rf"(?P<f>{_CAP}(?:-{_CAP})?) (?:(?P<i>[{_U}])\. )?(?:{PARTICLE} )?(?P<l>{_CAP}(?:-{_CAP})?)",
    rf"(?P<l>{_CAP}(?:-{_CAP})?), (?P<f>{_CAP})",
    rf"(?P<i>[{_U}])\. ?(?:[{_U}]\. ?)?(?:{PARTICLE} )?(?P<l>{_CAP}(?:-{_CAP})?)",
    rf"(?P<l>{_CAP}(?:-{_CAP})?),? (?P<i>[{_U}])\.(?: ?[{_U}]\.)?",
)
_HAN = "一-鿿々ノヶ"
_KANJI = rf"[{_HAN}]+(?: [{_HAN}]+)?"


@functools.cache
def _compiled():
    def spaced(pattern: str) -> re.Pattern:
        """With up to three blanks for one."""
        return re.compile(pattern.replace(" ?", "[ ]{0,3}").replace(" ", "[ ]{1,3}").replace("[[ ]{1,3}]", "[ ]"))

    return (
        re.compile(EMAIL, re.I),
        [re.compile(p) for p in NUMBERS],
        {k: spaced(p) for k, p in ADDRESSES.items()},
        [spaced(p) for p in NAMES],
        re.compile(rf"(?<![{_U}{_L}0-9.@_-])[{_U}]"),
        re.compile(_KANJI),
    )


@functools.cache
def _plain_char(ch: str) -> str:
    """One character for one, so that places stay: compatible forms, kinds of blanks and of hyphens become plain."""
    if ch in "\n\r\t":
        return "\n" if ch != "\t" else " "
    if ch.isspace() or ch in "​﻿⁠":
        return " "
    if ch in "‐‑‒﹣－":
        return "-"
    if ch in "ºª":
        return ch
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 else ch


def plain(text: str) -> str:
    return text if text.isascii() else "".join(map(_plain_char, text))


_DIGITS, _MARKS, _ONLY_MARKS = re.compile(r"\d+"), re.compile(r"^\W+"), re.compile(r"[\W\d]+")
_SENTENCE, _AFTER = re.compile(r"\w{4}[.!?]$"), re.compile(r"[\s,]*(\w+|[^\w\s])")


def _before_span(text: str, start: int) -> tuple[str, str, bool] | None:
    """The word before a place, the two words before it, and whether the script has no blanks; None where they say nothing."""
    left = text[max(0, start - 40) : start]
    bare = left.rstrip()
    wide = any(ord(c) > 0x2E80 for c in bare[-3:])
    if wide:
        if bare[-1] in "。！？":
            return None
        one, two = bare[-3:], bare[-5:]
    else:
        words = [_MARKS.sub("", w) or w for w in left.lower().split()[-2:]]
        if not words or "\n" in left[len(bare) :]:
            return None
        one, two = words[-1], " ".join(words)
    if _ONLY_MARKS.fullmatch(one) and one != ":" or _SENTENCE.search(one):
        return None  # the end of a sentence or a mark of a list says nothing
    return _DIGITS.sub("0", one), _DIGITS.sub("0", two), wide


def _after_span(text: str, stop: int, wide: bool) -> str:
    """The word or sign after a place."""
    right = text[stop : stop + 24]
    if wide:
        return _DIGITS.sub("0", right.lstrip()[:2])
    found = _AFTER.match(right.lower())
    return _DIGITS.sub("0", found[1]) if found else ""


def _contexts(text: str, start: int, stop: int, known: dict) -> list[str]:
    """Lexical patterns around a span: the word before, two words before, and the words on both sides. ``known`` keeps what places say."""
    if start not in known:
        known[start] = _before_span(text, start)
    if (before := known[start]) is None:
        return []
    one, two, wide = before
    if (at := (stop, wide)) not in known:
        known[at] = _after_span(text, stop, wide)
    return [f"1 {one}", f"2 {two}", f"3 {one} _ {known[at]}"]


def _form(s: str) -> str:
    s = re.sub(r"\s+", " ", s)
    form = re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s))
    return f"{form}|{s[0] if s[0].isdigit() and 'A' not in form else ''}"


def _number_candidates(text: str) -> Iterator[tuple[str, int, int, list[str]]]:
    _, numbers, *_ = _compiled()
    taken: list[tuple[int, int]] = []
    for k, pattern in enumerate(numbers):
        for m in pattern.finditer(text):
            if sum(map(str.isdigit, m[0])) < (8 if k == 0 else 5) or any(a < m.end() and m.start() < b for a, b in taken):
                continue
            if k < 3:
                taken.append(m.span())
                yield "number", m.start(), m.end(), ["plus" if k == 0 else _form(m[0])]
                continue
            # a letter that touches the number belongs to it, one after a blank may
            lead, tail = m["lead"], m["tail"]
            starts = ({m.start("lead")} if lead else set()) | ({m.start("core")} if not lead or lead.endswith(" ") else set())
            stops = ({m.end("tail")} if tail else set()) | ({m.end("ext") if m["ext"] else m.end("core")} if not tail or tail.startswith(" ") else set())
            if m["core"].count(" ") and (cut := m.start("core") + m["core"].rindex(" ")) > m.start() + 4:
                stops.add(len(text[:cut].rstrip()))  # the last group may be a house number
            for a in starts:
                for b in stops:
                    yield "number", a, b, [_form(text[a:b])]


def _title_at(run: str) -> int:
    """Where a title begins in a run of Han signs, else its end."""
    return min([len(run), *(x for h in HONORIFICS if (x := run.find(h)) >= 0)])


def _name_candidates(text: str) -> Iterator[tuple[str, int, int, list[str]]]:
    *_, names, starts, kanji = _compiled()
    for at in starts.finditer(text):
        for pattern in names:
            m = pattern.match(text, at.start())
            if not m:
                continue
            g = m.groupdict()
            if g.get("i") and not g.get("f") and m.start("i") == m.start() and g["i"] in "NН" and re.search(r"\d[ ]{1,3}$", text[max(0, m.start() - 4) : m.start()]):
                continue  # a unit after a number
            if g.get("f") and (g["f"].lower() in TITLES or g["l"].lower() in TITLES) or (not g.get("f") and g["l"].lower() in TITLES):
                continue
            tokens = (g["f"].split("-") if g.get("f") else []) + g["l"].split("-")
            yield "name", m.start(), m.end(), [unicodedata.normalize("NFC", t).lower() for t in tokens]
    for m in kanji.finditer(text):
        family, _, given = m[0].partition(" ")  # a part of a name is known by where it stands
        at = m.start()
        if given:
            for i in range(1, min(4, len(family)) + 1):
                for k in range(1, min(4, _title_at(given)) + 1):
                    yield "name", at + len(family) - i, at + len(family) + 1 + k, [f"姓{family[-i:]}", f"名{given[:k]}"]
        for run, begin in ((family, at), (given, at + len(family) + 1)):
            for o in (o for o in range(len(run) - 1) if not run.startswith(HONORIFICS, o)):
                stop = o + 1 + _title_at(run[o + 1 :])
                for i in (1, 2, 3):
                    for j in (1, 2, 3):
                        if o + i + j <= stop:
                            yield "name", begin + o, begin + o + i + j, [f"姓{run[o : o + i]}", f"名{run[o + i : o + i + j]}"]


def _address_candidates(text: str) -> Iterator[tuple[str, int, int, list[str]]]:
    for form, pattern in _compiled()[2].items():
        for m in pattern.finditer(text):
            if form == "end":  # the end of a word, long or short, may be a street's
                end = m["end"].lower()
                for n in _ENDS:
                    if n <= len(end):
                        yield "address", m.start(), m.end(), [f"end {end[-n:]}"]
            else:
                key = re.sub(r"\d+", "0", m["key"].lower())
                yield "address", m.start(), m.end(), [f"en {key}{_LONG}" if form == "en_long" else f"{form} {key}"]


def candidates(text: str) -> list[tuple[str, int, int, list[str], list[str]]]:
    """(group, start, stop, items, contexts) of everything that may be personal information in a text.

    Groups: email, number, address and name; and mail, the words of an email's local part, which has no contexts.
    """
    text = plain(text)
    email, known = _compiled()[0], {}
    out, emails = [], []
    for m in email.finditer(text) if "@" in text or "at" in text.lower() else ():
        a, b = m.span()
        emails.append((a, b))
        local = text[a : m.start("at")].split("+")[0]  # what follows a plus is a tag
        out.append(("mail", a, b, [w for w in re.split(r"[^a-z]+", local.lower()) if len(w) > 2], []))
        dots = {f"dot {d.strip().lower()}" for d in _DOTS.findall(text[m.end("at") : b])}
        out.append(("email", a, b, [f"at {m['at'].strip().lower()}", *sorted(dots)], _contexts(text, a, b, known)))
    free = []
    if any(map(str.isdigit, text)):
        free += _number_candidates(text)
        free += _address_candidates(text)
    free += _name_candidates(text)
    for group, a, b, items in free:
        if group == "address":  # a list may go on with an email
            b = min([b, *(len(text[:x].rstrip(", ")) for x, _ in emails if a < x < b)])
        if not any(x < b and a < y for x, y in emails):
            # three words before a street's teach nothing: the last may be what follows an address
            out.append((group, a, b, [x.removesuffix(_LONG) for x in items], [] if items[-1].endswith(_LONG) else _contexts(text, a, b, known)))
    return out


_SPAN = "array<struct<group:string,start:int,stop:int,items:array<string>,contexts:array<string>>>"


def candidate_spans(text: Column) -> Column:
    @F.pandas_udf(_SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("group", "start", "stop", "items", "contexts"), c)) for c in candidates(t or "")] for t in texts], dtype=object)

    return spans(text)


#: Items that are known from the start, by kind: public formats of telephone and identity numbers (digits as 0, letters as A,
#: then the first digit where it matters) and usual forms of streets. Names come from email addresses and after titles.
SEEDS = {
    "phone": r"^plus$|^\(\+?0{2,4}\)|^000-000-0000( ext\.? ?0+)?\|[2-9]$|^000\.000\.0000\|[2-9]$|^0{5} 0{6}\|0$|^00 00 00 00 00\|0$|^00\.00\.00\.00\.00\|0$|^0\(000\)0{7}\|8$|^000-0000-0000\|0$",
    "id_number": r"^000-00-0000\|9$|^000 00 0000\|9$|^AA 00 00 00 A\|$|^0{8}-?A\|$|^A-0{7}-A\|$|^000-000-000 00\||^0 00 00 00 000 000 00\|",
    "address": r"^(en (street|lane|road|rd|ave|avenue)|end (traße|tr\.|weg)|fr (rue|av\.|impasse)|first (calle|c/|avda\.)|ru (ул\.|пер\.)|ja 0-0-0)$",
    "email": r"^at (@|\[at\]|\(at\))$|^dot (\.|\[dot\])$",
}
TITLE_CONTEXTS = ("1 dr.", "1 dr", "1 prof.", "1 mr.", "1 mrs.", "1 ms.", "1 herr", "1 frau", "1 mme", "1 sra.", "1 sr.")
_GROUP = {"phone": "number", "id_number": "number", "address": "address", "name": "name", "email": "email"}
_log = logging.getLogger(__name__)


def bootstrap(edges: DataFrame, seeds: DataFrame, occurrences: DataFrame, never: DataFrame, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Items and contexts of each kind, from the graph of items and the contexts in which they occur.

    ``edges``: group, item, context, n; an occurrence has up to three. ``seeds``: group, item, kind. ``occurrences``: group,
    item, n, those without contexts too. ``never``: group, item that become of no kind. A context is sure of a kind if that share of what
    stands in it are items of the kind; an item is of a kind if that share of its occurrences stand in contexts that are
    sure of it, more than in those of another kind. Scores go back and forth until no item changes; seeds stay.
    Result: items (group, item, kind), contexts (group, context, kind, sure, seen).

    The edges are as many as different pairs, not as occurrences. Items and contexts are lookups (see lookup_join), so that a
    common one is no single task.
    """
    in_context = written(edges.groupBy("group", "context").agg(F.sum("n").alias("all")))
    placed = edges.groupBy("group", "item").agg(F.sum("n").alias("placed"))
    of_item = written(occurrences.select("group", "item", (3 * F.col("n")).alias("all")).join(placed, ["group", "item"], "left"))
    items, contexts, before = written(seeds), None, None
    enough, share = (F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("group")] for d in (SURE, SHARE))
    for _ in range(most_rounds):
        now = items.agg(F.count("*"), F.sum(F.xxhash64("group", "item", "kind").cast("decimal(20,0)")), F.sum(size_of_row(items))).first()
        if now == before:
            break
        before, fits = now, now[0] <= BROADCAST_ROWS and (now[2] or 0) <= BROADCAST_BYTES
        hits = lookup_join(edges, items, ["group", "item"], F.col("context"), "inner", fits).groupBy("group", "context", "kind").agg(F.sum("n").alias("seen"))
        contexts = hits.where(F.col("seen") >= SEEN).join(in_context, ["group", "context"]).withColumn("sure", F.col("seen") / F.col("all")).where(F.col("sure") >= enough).drop("all")
        contexts = written(contexts)
        in_sure = lookup_join(edges, contexts.select("group", "context", "kind"), ["group", "context"], F.col("item"), "inner").groupBy("group", "item", "kind").agg(F.sum("n").alias("n"))
        best = Window.partitionBy("group", "item").orderBy(F.desc("n"), "kind")
        found = in_sure.where(F.col("n") >= SEEN).withColumn("_r", F.row_number().over(best)).where("_r = 1").join(of_item, ["group", "item"])
        street = (F.col("group") != "address") | (F.col("n") >= STREET_SHARE * F.col("placed"))
        found = found.where((F.col("n") >= share * F.col("all")) & street).select("group", "item", "kind").join(never, ["group", "item"], "left_anti")
        items = written(found.join(seeds, ["group", "item"], "left_anti").unionByName(seeds))
    else:
        _log.warning("items still change after %d rounds", most_rounds)
    return items, contexts


def _by_ending(known: DataFrame, items: DataFrame) -> DataFrame:
    """Words that end as many names and few other words do, as further names."""
    words = known.where((F.col("group") == "name") & (F.length("item") > ENDING)).join(items.select("group", "item", "kind"), ["group", "item"], "left")
    words = words.withColumn("ending", F.substring("item", -ENDING, ENDING))
    endings = words.groupBy("ending").agg(F.count("kind").alias("names"), F.count("*").alias("all")).where((F.col("names") >= ENDING_NAMES) & (F.col("names") >= ENDING_SHARE * F.col("all")))
    return words.where("kind is null").join(endings, "ending").select("group", "item", F.lit("name").alias("kind"))


def _best(spans: list) -> list[tuple[str, int, int]]:
    """Spans without overlap: emails first, then from left to right the longest; one that lies inside an address is part of it."""
    spans = sorted({(s["kind"], s["start"], s["stop"]) for s in spans}, key=lambda s: (s[0] != "email", s[0] != "address", s[1], s[1] - s[2], s[0]))
    names = [s for s in spans if s[0] == "name"]

    def cut(s: tuple[str, int, int]) -> tuple[str, int, int]:
        """An address without a name that it ends in: a list goes on after the comma."""
        ends = [n[1] for n in names if s[1] + 6 < n[1] < s[2] <= n[2]]
        return (s[0], s[1], min(ends) - 2) if s[0] == "address" and ends else s

    spans = [cut(s) for s in spans]
    taken: list[tuple[str, int, int]] = []
    for kind in (("email",), ("address",), ("phone", "id_number", "name")):
        end = -1
        for s in spans:
            if s[0] in kind and s[1] >= end and not any(a < s[2] and s[1] < b for _, a, b in taken if _ not in kind):
                taken.append(s)
                end = s[2]
    return sorted(taken, key=lambda s: s[1])


def personal_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: dict[str, str] | None = None) -> DataFrame:
    """One row per document that has any: ``id_col``, text_hash and spans, an array of (kind, start, stop) in code points from 0.

    Candidates of every document (shapes of numbers, streets and names) form a graph with their contexts over the whole
    corpus. Public forms of emails, a few public formats of numbers and street words (``seeds``, by default SEEDS) are seeds: they show which contexts hold which kind, those show
    further formats and names, and so on (see bootstrap). A span counts if its format, or all words of the name, are
    of a kind, or if its context alone is sure enough. Further forms of obfuscated emails are found like other formats.

    Null and empty texts have no spans; other columns are ignored. Spans belong to an id and its text: documents that share an id,
    or have none, but differ in text come out apart (text_hash tells them apart). Spans don't overlap: emails go
    first, then addresses, then the others from left to right, the longest first. A document's spans are collected, no
    more than that; items and contexts are joined, by broadcast only within a measured bound.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    found = documents.where(F.col(text_col).isNotNull()).select(key.alias("_id"), F.explode(candidate_spans(F.col(text_col))).alias("_c")).select("_id", "_c.*")
    found = written(found)
    others = found.where("group <> 'mail'")
    pairs = others.where("group = 'name' and size(items) = 2 and items[0] rlike '^姓.$'").select(F.get("items", F.lit(0)).alias("item"), F.get("items", F.lit(1)).alias("_given")).distinct()
    fixed = written(pairs.groupBy("item").count().where(F.col("count") < PARTNERS).select(F.lit("name").alias("group"), "item"))
    edges = others.select("group", F.explode("items").alias("item"), "contexts").select("group", "item", F.explode("contexts").alias("context")).groupBy("group", "item", "context").agg(F.count("*").alias("n"))
    edges = written(edges)
    occurrences = written(others.select("group", F.explode("items").alias("item")).groupBy("group", "item").agg(F.count("*").alias("n")))
    known = occurrences.select("group", "item")
    kind = F.when(F.lit(False), "")
    for k, pattern in (SEEDS if seeds is None else seeds).items():
        kind = kind.when((F.col("group") == _GROUP[k]) & F.col("item").rlike(pattern), k)
    words = found.where("group = 'mail'").select(F.explode("items").alias("item")).distinct().withColumn("group", F.lit("name"))
    first = known.withColumn("kind", kind).where("kind is not null").unionByName(known.join(words, ["group", "item"], "left_semi").withColumn("kind", F.lit("name")))
    titled = edges.where((F.col("group") == "name") & F.col("context").isin(*TITLE_CONTEXTS)).select("group", "item", F.lit("name").alias("kind"))
    first = first.unionByName(titled).distinct()
    items, contexts = bootstrap(edges, written(first), occurrences, fixed)
    items = written(items.unionByName(_by_ending(known, items)))
    # what each candidate's items and contexts say
    span = ["_id", "group", "start", "stop"]
    by_item = lookup_join(others.select(*span, F.size("items").alias("_all"), F.posexplode("items").alias("_nth", "item")), items, ["group", "item"], F.col("_id"), "inner")
    whole = by_item.groupBy(*span, "kind").agg(F.bit_or(F.pow(F.lit(2), F.col("_nth")).cast("bigint")).alias("_n"), F.max("_all").alias("_all")).where("bit_count(_n) = _all").select(*span, "kind")
    alone = contexts.where((F.col("sure") >= ALONE_SURE) & (F.col("seen") >= ALONE_SEEN) & F.col("kind").isin("name", "id_number", "phone")).select("group", "context", "kind")
    by_context = lookup_join(others.select(*span, F.explode("contexts").alias("context")), alone, ["group", "context"], F.col("_id"), "inner").select(*span, "kind")
    spans = whole.unionByName(by_context).distinct()

    @F.pandas_udf("array<struct<kind:string,start:int,stop:int>>")
    def best(lists: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "stop"), s)) for s in _best(list(spans))] for spans in lists], dtype=object)

    by_document = spans.groupBy("_id").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("spans"))
    return by_document.select(F.col("_id.id").alias(id_col), F.col("_id.hash").alias("text_hash"), best("spans").alias("spans"))


def redacted(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, each span replaced by its kind in brackets, as in [EMAIL]; the rest of the text is unchanged."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, lists):
            if text is not None and spans is not None:
                for s in sorted(spans, key=lambda s: -s["start"]):
                    text = f"{text[: s['start']]}[{s['kind'].upper()}]{text[s['stop'] :]}"
            out.append(text)
        return pd.Series(out, dtype=object)

    mine = documents.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("_key"), id_col, text_col)
    theirs = spans.select(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).alias("_key"), "spans")
    return mine.join(theirs, "_key", "left").select(id_col, replaced(text_col, "spans").alias(text_col))
