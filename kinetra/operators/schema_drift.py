"""Schemas that drift between files."""

from __future__ import annotations

import difflib
import functools
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, merged, shuffle_partitions, written
from kinetra.operators.ordered_windows import carried, indexed, own, with_neighbours

#: How far the level of a quantity moves between two files: of a rotation's number, of any larger number.
NEAR_UNIT, NEAR = 0.004, 4.5
#: Cost of adding or of deleting a field (a rename costs less than both together) and a group of fields; of moving a field to another group.
ALONE, GROUP, MOVE = 1.0, 0.05, 0.02
#: Files of a campaign that one window orders.
BLOCK_FILES = 4_096
_NUMBER = r"[+-]?\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?"
#: One number with at most eight other signs (unit, ~, brackets) before and after it.
_MEASURED = rf"^[^\d.,+-]{{0,8}}{_NUMBER}[^\d]{{0,8}}$"
_DATETIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
#: Ends of names of quantities that are no part of a pose (fixed words of tracker logs).
_OTHER = re.compile(r"(res|vis|rms|err|count)(v\d+)?$")
_TOKEN = re.compile(r"(?<![A-Z])[A-Z][a-z]+|[A-Z]+|[a-z]+|\d+|[^\W\d_a-zA-Z]+")


# ---- a file's fields ----


def _clean(line: Column) -> Column:
    return F.regexp_replace(line, "^\\ufeff+", "")


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^[\\s\\ufeff]+|\\s+$", ""), '^"(.*)"$', "$1")


def _cells(line: Column, delimiter: Column) -> Column:
    """The line's cells, unquoted; delimiters inside quotes don't count."""
    simple = F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))
    quoted = F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit('\\E(?=(?:[^"]*"[^"]*")*[^"]*$)')))
    return F.transform(F.when(line.contains('"'), quoted).otherwise(simple), _unquoted)


def headers(lines: DataFrame) -> DataFrame:
    """One row per file: file_id, campaign_id, place in the campaign (from 1), _head (line_no of the header), _delimiter, _names.

    The header is the first line that is neither blank nor a remark (#). Its delimiter is the one of tab ; , | that it has
    most often. The files of a campaign are in the order of recorded_at (null first), then file_id; they are ordered by the hour, and the
    hours' counts give the places, so that no campaign is one task.
    """
    text = _clean(F.col("raw_line"))
    said = (F.trim(text) != "") & ~F.ltrim(text).startswith("#")
    firsts = lines.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(
        F.min("campaign_id").alias("campaign_id"), F.min("recorded_at").alias("recorded_at"), F.min(F.when(said & F.col("line_no").isNotNull(), F.struct("line_no", text.alias("text")))).alias("_first")
    ).where("_first is not null")
    firsts = written(firsts)
    keys, hour = ["_none", "_campaign"], 3_600_000_000
    at = F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(1 << 62)))
    files = firsts.select("file_id", F.col("campaign_id").isNull().alias("_none"), F.coalesce("campaign_id", F.lit(0)).alias("_campaign"), at.alias("_time"))
    placed, w = with_neighbours(indexed(files, keys, ["_time", "file_id"], F.floor(F.col("_time") / hour)), keys, 1, 0)
    placed = own(placed.withColumn("_before", F.lag("file_id").over(w))).select("file_id", "_before", (F.col("_at") + 1).alias("place"))
    head = F.col("_first.text")
    often = [F.struct(F.length(F.regexp_replace(head, f"[^{d}]", "")).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("d")) for i, (d, s) in enumerate((("\\t", "\t"), (";", ";"), (",", ","), ("|", "|")))]
    firsts = firsts.withColumn("_delimiter", F.greatest(*often)["d"]).join(merged(placed), "file_id")
    return firsts.select("file_id", "campaign_id", "place", "_before", F.col("_first.line_no").alias("_head"), "_delimiter", _cells(head, F.col("_delimiter")).alias("_names"))


def _readings(lines: DataFrame, heads: DataFrame, extra: list[str]) -> DataFrame:
    """The reading lines of each file with ``_cells`` and the extra columns of heads."""
    rows = lines.where("file_id is not null and line_no is not null").select("file_id", "line_no", _clean(F.col("raw_line")).alias("_text"))
    rows = rows.where((F.trim("_text") != "") & ~F.ltrim("_text").startswith("#"))
    joined = lookup_join(rows, heads.select("file_id", "_head", "_delimiter", *extra), ["file_id"], F.col("line_no"), "inner").where("line_no > _head")
    return joined.withColumn("_cells", _cells(F.col("_text"), F.col("_delimiter"))).drop("_text")


def _missing(cell: Column) -> Column:
    return cell.isNull() | F.lower(cell).isin("", "nan", "null")


def _first_number(cell: Column) -> Column:
    return F.translate(F.regexp_extract(cell, _NUMBER, 0), ",", ".").try_cast("double")


def profiles(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per file and field: file_id, campaign_id, place, field, kind (integer, decimal, datetime, text; null if all its values are missing), level (median of the numbers in it), clock.

    Of a name that a header has twice, the first column counts.
    """
    cells = _readings(lines, heads, []).select("file_id", F.posexplode("_cells").alias("_pos", "_cell")).where(~_missing(F.col("_cell")))
    cell = F.col("_cell")
    fits = {
        "integer": cell.rlike(r"^-?\d+$"),
        "decimal": cell.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"),
        "datetime": cell.rlike(_DATETIME),
    }
    seen = cells.groupBy("file_id", "_pos").agg(*[F.min(fit).alias(f"_{kind}") for kind, fit in fits.items()], F.percentile_approx(_first_number(cell), 0.5, 1000).alias("level"))
    kind = reduce(lambda other, k: F.when(F.col(f"_{k}"), k).otherwise(other), ("datetime", "decimal", "integer"), F.when(F.col("_integer").isNotNull(), "text"))
    names = heads.select("file_id", "campaign_id", "place", "_before", F.posexplode("_names").alias("_pos", "field")).where("field <> ''")
    names = names.groupBy("file_id", "field").agg(*[F.first(c).alias(c) for c in ("campaign_id", "place", "_before")], F.min("_pos").alias("_pos"))
    full = names.join(merged(seen), ["file_id", "_pos"], "left")
    clock = (F.col("_datetime") | (F.col("_integer") & (F.col("level") > 1e11))).alias("clock")
    return full.select("file_id", "campaign_id", "place", "_before", "field", F.col("_pos").alias("pos"), kind.alias("kind"), "level", clock)


# ---- the cheapest script from one file's tree of fields to the next one's ----


def _tokens(name: str) -> list[str]:
    """The words and numbers of a name: runs of capitals, of small letters (with a capital before) and of digits."""
    return [t.lower() for t in _TOKEN.findall(name)]


def _tail(tokens: list[str]) -> int:
    """How many of the last tokens make a part's label: those of together at most two signs, if something is left before them."""
    n, size = 0, 0
    while n + 1 < len(tokens) and size + len(tokens[-1 - n]) <= 2:
        size += len(tokens[-1 - n])
        n += 1
    return n


def _labels(names: list[str]) -> tuple[set[str], list[set[str]]]:
    """The labels of parts in a header, which are those under two or more groups, or under a group with three or more; and each group's labels."""
    under, of = defaultdict(set), defaultdict(set)
    for tokens in map(_tokens, names):
        if n := _tail(tokens):
            group, label = tuple(tokens[:-n]), "".join(tokens[-n:])
            under[label].add(group)
            of[group].add(label)
    return {label for label, groups in under.items() if len(groups) >= 2 or any(len(of[g]) >= 3 for g in groups)}, list(of.values())


@dataclass
class Leaf:
    """A field. body: the group it is a part of, as tokens; role: its label there; both empty where the names show none (see grouped)."""

    name: str
    kind: str | None
    level: float | None
    clock: bool
    body: tuple[str, ...] = ()
    role: str = ""
    beside: frozenset[str] = frozenset()  # labels that stand beside its own in one group

    def __post_init__(self):
        self.plain = re.sub(r"[^0-9a-z]", "", self.name.lower())
        self.other = m[1] if (m := _OTHER.search(self.plain)) else ""

    def grouped(self, labels: set[str], beside: dict[str, set[str]]) -> Leaf:
        """Sets body, role and beside by the labels that both headers use; one word after the label, as a unit, doesn't hide it."""
        tokens = _tokens(self.name)
        for cut in (tokens, tokens[:-1]):
            n = _tail(cut)
            if n and "".join(cut[-n:]) in labels:
                self.body, self.role = tuple(cut[:-n]), "".join(cut[-n:])
                self.beside = frozenset(beside.get(self.role, ()))
                break
        return self

    @property
    def plain_body(self) -> str:
        return "".join(self.body)


def _same_name(a: str, b: str) -> bool:
    """Whether two plain names are spellings of one: equal, or one lacks the other's first part."""
    return bool(a) and bool(b) and (a == b or (min(len(a), len(b)) >= 3 and (a.endswith(b) or b.endswith(a))))


@functools.lru_cache(100_000)
def _alike(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _levels_agree(a: Leaf, b: Leaf) -> float | None:
    """How well two levels agree, 0 (equal) to 1; above 1: they don't; None: unknown on a side, or no fixed level."""
    if a.level is None or b.level is None or a.clock or b.clock:
        return None
    x, y = a.level, b.level
    if "integer" in (a.kind, b.kind) and a.kind != b.kind:  # thousandths as integers, or rounded
        whole, part = (x, y) if a.kind == "integer" else (y, x)
        return min(abs(whole - 1000 * part) / (1000 * NEAR_UNIT), 2.0 if abs(part) < 2 else abs(whole - part) / NEAR)
    unit = max(abs(x), abs(y)) < 1.5
    return abs(x - y) / (NEAR_UNIT if unit else NEAR)


def _leaf_cost(a: Leaf, b: Leaf, same_body: bool | None) -> float:
    """Cost of renaming a into b; 2 * ALONE or more: cheaper to delete and add. same_body: what the rest of both bodies says."""
    never = 2 * ALONE + 1
    if b.role in a.beside or a.other != b.other:
        return never  # another part of the same group
    if a.plain and a.plain == b.plain:
        return 0.1  # another spelling
    if a.clock or b.clock:
        return 0.3 * (1 - _alike(a.plain, b.plain)) if a.clock and b.clock else never
    spelled = a.plain == b.plain or (a.role and a.role == b.role and _same_name(a.plain_body, b.plain_body))
    agree = _levels_agree(a, b)
    counts = a.kind == b.kind == "integer" and not a.role and not b.role
    if agree is None or counts or (a.kind == b.kind == "text" and a.level is None):
        if a.role and b.role and same_body is not None:
            return 0.2 if same_body else never
        close = spelled or (not (a.role and b.role) and (a.plain.startswith(b.plain) or b.plain.startswith(a.plain)) and min(len(a.plain), len(b.plain)) >= 5)
        return 0.5 + 0.5 * (1 - _alike(a.plain, b.plain)) if close else never
    if same_body is False and a.role and b.role:
        return never
    if agree > 1:
        return 0.9 + 0.5 * (1 - _alike(a.plain, b.plain)) if spelled and agree < 4 else never
    return 0.6 * agree + 0.5 * (1 - _alike(a.plain, b.plain))


def cheapest_pairs(cost: list[list[float]] | np.ndarray, alone: float = ALONE) -> list[tuple[int, int]]:
    """The pairs (row, column) of the assignment that costs least, where each row or column may stay alone for ``alone``.

    Only pairs cheaper than both alone matter; they fall into components, each solved by itself.
    """
    gain = np.asarray(cost, float) - 2 * alone
    if not gain.size:
        return []
    rows, columns = np.nonzero(gain < 0)
    root = list(range(sum(gain.shape)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(rows.tolist(), columns.tolist()):
        root[find(i)] = find(len(gain) + j)
    parts = defaultdict(lambda: (set(), set()))
    for i, j in zip(rows.tolist(), columns.tolist()):
        of = parts[find(i)]
        of[0].add(i)
        of[1].add(j)
    out = []
    for some_rows, some_columns in parts.values():
        r, c = sorted(some_rows), sorted(some_columns)
        out += [(r[i], c[j]) for i, j in _assigned(np.minimum(gain[np.ix_(r, c)], 0.0))]
    return sorted(out)


def _assigned(gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of least total gain (none above 0); each row has a column of gain 0 of its own beside the shared ones."""
    n, m = gain.shape
    c = np.full((n, m + n), np.inf)
    c[:, :m] = gain
    c[np.arange(n), m + np.arange(n)] = 0.0
    u, v, match = np.zeros(n), np.zeros(m + n), np.full(m + n, -1)
    for i in range(n):  # shortest augmenting path from row i, with potentials
        dist, way, used = c[i] - u[i] - v, np.full(m + n, -1), np.zeros(m + n, bool)
        while True:
            j = int(np.argmin(np.where(used, np.inf, dist)))
            low = dist[j]
            used[j] = True
            if match[j] < 0:
                break
            r = match[j]
            through = low + c[r] - u[r] - v
            better = ~used & (through < dist)
            dist[better], way[better] = through[better], j
        seen = np.flatnonzero(used)
        v[seen] += dist[seen] - low
        owners = match[seen[match[seen] >= 0]]
        u[owners] += low - dist[seen[match[seen] >= 0]]
        u[i] += low
        while j >= 0:
            before = way[j]
            match[j] = match[before] if before >= 0 else i
            j = before
    return [(int(match[j]), int(j)) for j in range(m) if match[j] >= 0 and gain[match[j], j] < 0]


@dataclass
class Node:
    """A group of fields: its words, the numbers of the fields in it, and the groups in it."""

    words: tuple[str, ...]
    leaves: list[int] = field(default_factory=list)
    kids: list[Node] = field(default_factory=list)

    def all_leaves(self) -> list[int]:
        return self.leaves + [x for k in self.kids for x in k.all_leaves()]


def tree_of(bodies: list[tuple[str, ...]]) -> Node:
    """The tree of groups by their words, nested as deep as the names are; a group that holds nothing but another is one with it."""
    root = Node(())
    for i, body in enumerate(bodies):
        at = root
        for k in range(len(body)):
            at = next((x for x in at.kids if x.words == body[: k + 1]), None) or at.kids.append(Node(body[: k + 1])) or at.kids[-1]
        at.leaves.append(i)

    def short(node: Node) -> Node:
        node.kids = [short(k) for k in node.kids]
        return node.kids[0] if node.words and len(node.kids) == 1 and not node.leaves else node

    return short(root)


def tree_edit(old: Node, new: Node, cost: np.ndarray) -> tuple[float, list[tuple[Node, Node]]]:
    """What the cheapest script saves against deleting the old tree and adding the new one (0 or less), and the groups that it maps.

    The edit distance between unordered trees whose mappings keep groups that lie apart, apart. ``cost``: of
    renaming an old field into a new one. Renaming a group costs nothing if its last word stays, else GROUP; deleting and
    adding one costs GROUP each, as ALONE does for a field. The roots are mapped.
    """
    known: dict[tuple[bool, int, int], tuple[float, list]] = {}
    gain = np.minimum(cost - 2 * ALONE, 0.0)

    held: dict[int, np.ndarray] = {}

    words: dict[int, dict[str, Node]] = {}  # of each group and those in it, by their last word

    def hold(node: Node) -> None:
        held[id(node)] = np.array(node.all_leaves(), int)
        for k in node.kids:
            hold(k)
        words[id(node)] = {w: x for k in node.kids for w, x in words[id(k)].items()} | ({node.words[-1]: node} if node.words else {})

    hold(old)
    hold(new)
    least = lambda x: float(x.min()) if x.size else 0.0

    def forest(x: Node, y: Node) -> tuple[float, list[tuple[Node, Node]]]:
        if (key := (False, id(x), id(y))) not in known:
            n, m = len(x.leaves), len(y.leaves)
            g = np.zeros((n + len(x.kids), m + len(y.kids)))
            within = gain[held[id(x)]]  # all fields in x against all new ones
            if n and m:
                g[:n, :m] = gain[np.ix_(x.leaves, y.leaves)]
            own, best = gain[x.leaves], within.min(0) if len(within) else np.zeros(gain.shape[1])
            useful_y = []
            for j, k in enumerate(y.kids):
                if n:
                    g[:n, m + j] = own[:, held[id(k)]].min(1) if held[id(k)].size else 0
                if least(best[held[id(k)]]) < 0 or (k.kids and x.kids):
                    useful_y.append(k)
            across = gain[:, held[id(y)]].min(1) if held[id(y)].size else np.zeros(len(gain))
            useful_x = [k for k in x.kids if least(across[held[id(k)]]) < 0 or (k.kids and y.kids)]
            for i, k in enumerate(x.kids):
                nearest = gain[held[id(k)]].min(0) if held[id(k)].size else np.zeros(gain.shape[1])
                if m:
                    g[n + i, :m] = nearest[y.leaves]
                for j, l in enumerate(y.kids):
                    if k.kids or l.kids or least(nearest[held[id(l)]]) < 0:
                        g[n + i, m + j] = tree(k, l)[0]
                    else:  # nothing but the groups themselves to map
                        g[n + i, m + j] = -2 * GROUP if k.words[-1] == l.words[-1] else -GROUP
            pairs = cheapest_pairs(g + 2 * ALONE) if g.size else []
            options = [(sum(float(g[p]) for p in pairs), [q for i, j in pairs if i >= n and j >= m for q in tree(x.kids[i - n], y.kids[j - m])[1]])]
            options += [forest(x, k) for k in useful_y] + [forest(k, y) for k in useful_x]
            known[key] = min(options, key=lambda o: o[0])
        return known[key]

    def tree(x: Node, y: Node) -> tuple[float, list[tuple[Node, Node]]]:
        if (key := (True, id(x), id(y))) not in known:
            saved, pairs = forest(x, y)
            same = x.words[-1:] == y.words[-1:]
            alone = least(gain[np.ix_(held[id(x)], held[id(y)])])
            options = [(saved - (2 * GROUP if same else GROUP), [(x, y), *pairs]), (alone, [])]
            best = gain[held[id(x)]].min(0) if held[id(x)].size else np.zeros(gain.shape[1])
            across = gain[:, held[id(y)]].min(1) if held[id(y)].size else np.zeros(len(gain))
            for k in y.kids:  # a group without groups and without fields to rename can only be mapped itself
                bare = not k.kids and least(best[held[id(k)]]) == 0
                options.append(tree(x, k) if not bare else (-2 * GROUP, [(words[id(x)][k.words[-1]], k)]) if k.words[-1] in words[id(x)] else (-GROUP, [(x, k)]))
            for k in x.kids:
                bare = not k.kids and least(across[held[id(k)]]) == 0
                options.append(tree(k, y) if not bare else (-2 * GROUP, [(k, words[id(y)][k.words[-1]])]) if k.words[-1] in words[id(y)] else (-GROUP, [(k, y)]))
            known[key] = min(options, key=lambda o: o[0])
        return known[key]

    saved, pairs = forest(old, new)
    return saved, [(old, new), *pairs]


def edit_script(old: list[Leaf], new: list[Leaf], old_names: list[str] | None = None, new_names: list[str] | None = None) -> list[tuple[str, str, str]]:
    """The renames and moves (operation, old, new) of the cheapest script between two trees of fields; other fields are deleted or added.

    Both headers' names (those of the leaves if not given) show which labels are parts of groups; groups nest by their words.
    The tree edit distance maps groups onto groups. Given that, the fields are assigned at least cost, where a field that leaves
    its group costs MOVE more. Whether two groups can be the same is also seen from their parts' levels. A single field of a group of four or more
    that comes or goes as a whole is no rename.
    """
    (before, groups), (after, more) = (_labels(names or [x.name for x in side]) for names, side in ((old_names, old), (new_names, new)))
    labels, beside = before & after, defaultdict(set)
    for group in groups + more:
        for label in group & labels:
            beside[label] |= group - {label}
    for leaf in [*old, *new]:
        leaf.grouped(labels, beside)
    by_body: tuple[dict, dict] = (defaultdict(dict), defaultdict(dict))
    for side, leaves in zip(by_body, (old, new)):
        for leaf in leaves:
            if leaf.body:
                side[leaf.body][leaf.role] = leaf
    bodies: dict[tuple, bool | None] = {}
    for x, xs in by_body[0].items():
        for y, ys in by_body[1].items():
            known = [k for role in xs.keys() & ys.keys() if (k := _levels_agree(xs[role], ys[role])) is not None]
            good = sum(k <= 1 for k in known)
            if len(known) >= 2:
                bodies[x, y] = good > len(known) / 2
            else:
                bodies[x, y] = None if not known or good else False
            if bodies[x, y] is None and not known and _same_name("".join(x), "".join(y)):
                bodies[x, y] = True
    cost = np.array([[_leaf_cost(a, b, bodies.get((a.body, b.body))) for b in new] for a in old]).reshape(len(old), len(new))
    trees = tree_of([a.body for a in old]), tree_of([b.body for b in new])
    mapped = {(x.words, y.words) for x, y in tree_edit(*trees, cost)[1]}
    stays = np.array([[(a.body, b.body) in mapped for b in new] for a in old]).reshape(cost.shape)
    pairs = [(old[i], new[j], bool(stays[i, j])) for i, j in cheapest_pairs(cost + MOVE * ~stays)]

    def whole(leaves: list[Leaf], leaf: Leaf, matched: list[Leaf]) -> bool:
        """Whether the leaf's group comes or goes as a whole, but for this leaf."""
        return bool(leaf.role) and sum(x.body == leaf.body for x in leaves) >= 4 and sum(x.body == leaf.body for x in matched) == 1

    olds, news = [p[0] for p in pairs], [p[1] for p in pairs]
    return [("rename" if s else "move", a.name, b.name) for a, b, s in pairs if a.plain == b.plain or not (whole(old, a, olds) or whole(new, b, news))]


def _scripts(fields: Column, old_names: Column, new_names: Column) -> Column:
    @F.pandas_udf("array<struct<op:string,old_field:string,new_field:string>>")
    def scripts(fields: pd.Series, old_names: pd.Series, new_names: pd.Series) -> pd.Series:
        def one(rows, olds, news) -> list[dict]:
            rows = sorted(rows, key=lambda r: r["field"])
            sides = [[Leaf(r["field"], r["kind"], r["level"], bool(r["clock"])) for r in rows if r["is_new"] == new] for new in (False, True)]
            return [dict(zip(("op", "old_field", "new_field"), x)) for x in edit_script(*sides, list(olds), list(news))]

        return pd.Series([one(*x) for x in zip(fields, old_names, new_names)], dtype=object)

    return scripts(fields, old_names, new_names)


# ---- the whole corpus of files ----


@dataclass
class Drift:
    """heads: see headers. fields: per file and field its lineage (the same for a field under whatever name), kind and last_kind. changes: the report. script: the renames and moves."""

    heads: DataFrame
    fields: DataFrame
    changes: DataFrame
    script: DataFrame


def schema_drift(lines: DataFrame) -> Drift:
    """The changes of fields between consecutive files of a campaign.

    ``lines``: file_id, campaign_id, recorded_at, line_no, raw_line; in any order, repeated rows change nothing. ``changes``
    has file_id, change_kind (added, removed, renamed, retyped), old_field, new_field. Null file ids, null line numbers
    and null or blank lines are ignored; a file without a header has no fields and isn't part of its campaign; files
    whose campaign is null form one campaign.

    Fields of equal names are the same. Where names differ, both files' fields form trees (groups with their parts) and
    the cheapest edit script between them (see edit_script) says what was renamed, moved, added or removed; the report calls a move renamed. Costs come
    from the levels of the values (a field without values has the last level of its name) and from the names. The scripts of all pairs of
    files are independent of each other, a row each, spread over all shuffle partitions. A field's lineage follows the renames; its last known type is
    carried along the lineage.

    Only profiles, one row per file and field, are compared; the lines are aggregated where they are. What goes along the
    files of a campaign is carried from block to block of BLOCK_FILES files, so that no campaign or lineage is one task.
    """
    heads = written(headers(lines))
    profile = written(profiles(lines, heads))
    known = carried(profile, ["campaign_id", "field"], "place", {"_level": F.col("level"), "_clock": F.col("clock"), "_kind": F.col("kind")}, block=BLOCK_FILES)
    after = heads.where("_before is not null").select(F.col("_before").alias("file_id"), F.col("file_id").alias("_after"))
    seen = F.struct(F.col("_kind").alias("kind"), F.col("_level").alias("level"), F.coalesce("_clock", F.lit(False)).alias("clock"))
    own_profile = F.struct("campaign_id", "place", "pos", "kind", "level", "clock", "_before")
    new = known.select("file_id", "field", F.lit(True).alias("_new"), seen.alias("_seen"), own_profile.alias("_own"))
    old = known.join(merged(after), "file_id").select(F.col("_after").alias("file_id"), "field", F.lit(False).alias("_new"), seen.alias("_seen"), F.lit(None).cast(new.schema["_own"].dataType).alias("_own"))
    here, there = F.col("_new"), ~F.col("_new")
    sides = written(new.unionByName(old).groupBy("file_id", "field").agg(*[F.max(F.when(which, F.col(c))).alias(n) for n, which, c in (("_old", there, "_seen"), ("_now", here, "_seen"), ("_own", here, "_own"))]))
    lone = sides.where("(_old is null) != (_now is null)").select("file_id", "field", F.col("_now").isNotNull().alias("is_new"), F.coalesce("_now", "_old").alias("_s"), F.col("_own._before").alias("_b"))
    alone = lone.where("not is_new or _b is not null").select("file_id", "field", "is_new", "_s.*")
    todo = alone.groupBy("file_id").agg(F.collect_list(F.struct("field", "is_new", "kind", "level", "clock")).alias("_fields"), F.max("is_new").alias("_any"), F.min("is_new").alias("_all")).where("_any and not _all")
    names = heads.select("file_id", "_before", F.col("_names").alias("_new_names"))
    todo = todo.join(merged(names), "file_id").join(merged(heads.select(F.col("file_id").alias("_before"), F.col("_names").alias("_old_names"))), "_before")
    spread = todo.repartition(shuffle_partitions(lines), "file_id")  # by number: the rows are few, their work isn't
    renamed = written(spread.select("file_id", "_before", F.inline(_scripts(F.col("_fields"), F.col("_old_names"), F.col("_new_names")))))
    removed = alone.where("not is_new").select("file_id", F.col("field").alias("old_field")).join(merged(renamed), ["file_id", "old_field"], "left_anti")
    added = alone.where("is_new").select("file_id", F.col("field").alias("new_field")).join(merged(renamed), ["file_id", "new_field"], "left_anti")

    # a segment: a name in consecutive files of its campaign; renames link segments to lineages
    present = sides.where("_own is not null").select("file_id", "field", "_own.*", F.col("_old").isNull().alias("_begins"))
    present = carried(present, ["campaign_id", "field"], "place", {"_from": F.when(F.col("_begins"), F.col("place"))}, block=BLOCK_FILES)
    campaign = F.coalesce(F.col("campaign_id").cast("string"), F.lit(""))
    segments = present.withColumn("_segment", F.struct(campaign.alias("campaign"), "field", F.col("_from").alias("from_place")))
    at = segments.select("file_id", "field", "_segment")
    links = (
        merged(renamed).join(at.select("file_id", F.col("field").alias("new_field"), F.col("_segment").alias("_s")), ["file_id", "new_field"])
        .join(merged(at.select(F.col("file_id").alias("_before"), F.col("field").alias("old_field"), F.col("_segment").alias("_to"))), ["_before", "old_field"])
        .select("_s", "_to")
    )
    links = written(links)
    while True:  # each round doubles the renames that a link spans
        further = links.alias("a").join(merged(links).alias("b"), F.col("a._to") == F.col("b._s"), "left").select("a._s", F.coalesce("b._to", "a._to").alias("_to"), F.col("b._to").isNotNull().alias("_moved"))
        further = written(further)
        links = further.select("_s", "_to")
        if further.where("_moved").isEmpty():
            break
    lineage = lookup_join(segments, links.withColumnRenamed("_s", "_segment"), ["_segment"], F.col("place")).withColumn("lineage", F.coalesce("_to", "_segment"))
    fields = carried(lineage.select("file_id", "campaign_id", "place", "field", "pos", "kind", "level", "clock", "lineage"), ["lineage"], "place", {"last_kind": F.col("kind")}, before=True, block=BLOCK_FILES)
    fields = written(fields)
    retyped = fields.where("kind is not null and last_kind is not null and kind <> last_kind")
    retyped = retyped.join(merged(renamed.select("file_id", F.col("new_field").alias("field"), "old_field")), ["file_id", "field"], "left")
    changes = (
        added.select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), "new_field")
        .unionByName(removed.select("file_id", F.lit("removed").alias("change_kind"), "old_field", F.lit("").alias("new_field")))
        .unionByName(renamed.select("file_id", F.lit("renamed").alias("change_kind"), "old_field", "new_field"))
        .unionByName(retyped.select("file_id", F.lit("retyped").alias("change_kind"), F.coalesce("old_field", "field").alias("old_field"), F.col("field").alias("new_field")))
    )
    return Drift(heads, fields, changes, renamed)


def consistent_readings(lines: DataFrame, drift: Drift, columns: dict[str, str]) -> DataFrame:
    """All readings as file_id, campaign_id, line_no, the given columns (name to "double", "ms" or "string"), ``numbers``, ``times``, ``texts`` and ``others``.

    A field counts under the first name of its lineage. Each file's script is an array of names, divisors and types in the order of
    its columns; it turns the file's cells into a map, from which the columns are read. What isn't among the columns is in
    three maps by name, one type for a name in all files: ``times`` (ms) where a file has it as a clock; else ``numbers``
    where files with numbers only (or parts of a pose with numbers) are there and at least as many as those with text without any; else ``texts``. A cell of
    a number or time that can't be read so stays in ``texts``, so that nothing is lost. ``others`` holds the same cells as delivered.

    Numbers are the first number of their cell, with comma or point; outside the columns a cell must be one number
    with at most a unit, ~ or brackets around it. Thousandths that a file gives as integers are divided again: where that is nearer to the usual level of the lineage (else of the
    campaign's fields of that name), or, without one, where a quaternion's number is 2 or more. "ms" reads milliseconds, seconds
    (numbers below 1e11) and ISO times as milliseconds. Lines stored twice count once (of several lines with one number, the least).
    """
    level = F.col("level")
    known = F.when(F.col("kind").isin("decimal", "text"), level)
    middle = lambda v: F.percentile_approx(v, 0.5, 10_000)
    fields = drift.fields.withColumns({"_name": F.col("lineage.field"), "_campaign": F.col("lineage.campaign")})
    along = written(fields.groupBy("lineage").agg(middle(known).alias("_usual"), F.max(F.col("field").rlike(r"(?i)q[1-4]$")).alias("_unit")))
    of_name = written(fields.groupBy("_campaign", "_name").agg(middle(known).alias("_usual_name")).where("_usual_name is not null"))
    fields = lookup_join(lookup_join(fields, along, ["lineage"], F.col("place")), of_name, ["_campaign", "_name"], F.col("place"))
    fields = fields.withColumn("_usual", F.coalesce("_usual", "_usual_name"))
    nearer = (F.abs(level / 1000 - F.col("_usual")) < F.abs(level - F.col("_usual"))) | ((level == 0) & (F.abs("_usual") < 0.5))
    thousandths = F.coalesce(nearer, F.col("_unit") & (F.abs(level) >= 2))
    per = F.when((F.col("kind") == "integer") & ~F.col("clock") & thousandths, 1000.0).otherwise(1.0)
    votes = fields.groupBy("_name").agg(
        F.coalesce(F.max("clock"), F.lit(False)).alias("_time"), F.count_if(F.col("kind").isin("integer", "decimal") | (F.col("kind") == "text") & level.isNotNull() & F.col("_name").rlike("(?i)[qt][1-4]$")).alias("_n"), F.count_if((F.col("kind") == "text") & level.isNull()).alias("_words")
    )
    types = votes.select("_name", F.when(F.col("_time"), "ms").when((F.col("_n") > 0) & (F.col("_n") >= F.col("_words")), "double").otherwise("string").alias("_type"))
    named = lookup_join(fields.select("file_id", "pos", "_name", per.alias("_per")), written(types), ["_name"], F.col("file_id"), "inner")
    scripts = named.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_name", "_per", "_type"))).alias("_script"))
    heads = written(drift.heads.join(merged(scripts), "file_id").select("file_id", "campaign_id", "_head", "_delimiter", "_script"))
    once = lines.groupBy("file_id", "line_no").agg(F.min("raw_line").alias("raw_line"))
    rows = _readings(once, heads, ["campaign_id", "_script"])
    cell = F.transform("_script", lambda s: F.struct(s["_name"].alias("k"), F.struct(F.get(F.col("_cells"), s["pos"]).alias("c"), s["_per"].alias("f"), s["_type"].alias("t")).alias("v")))
    cells = F.map_from_entries(F.filter(cell, lambda e: ~_missing(e["v"]["c"])))
    rows = rows.withColumn("_map", cells)

    def millis(text: Column) -> Column:
        number = F.when(text.rlike(r"^\d+([.,]\d+)?$"), _first_number(text))
        return F.coalesce(F.round(F.when(number < 1e11, number * 1000).otherwise(number)).cast("bigint"), F.unix_millis(text.try_cast("timestamp")))

    def column(name: str, kind: str) -> Column:
        text, per = F.col("_map")[name]["c"], F.col("_map")[name]["f"]
        if kind == "double":
            return _first_number(text) / per
        if kind == "ms":
            return millis(text)
        return text

    rows = rows.withColumn("_rest", F.map_filter("_map", lambda k, _: ~k.isin(*columns)))
    typed = F.transform_values("_rest", lambda _, v: F.struct(
        F.when((v["t"] == "double") & v["c"].rlike(_MEASURED), _first_number(v["c"]) / v["f"]).alias("n"),
        F.when(v["t"] == "ms", millis(v["c"])).alias("ms"),
        v["c"].alias("c"),
    ))
    rows = rows.withColumn("_typed", typed)
    of = lambda part: F.transform_values(F.map_filter("_typed", lambda _, v: v[part].isNotNull()), lambda _, v: v[part])
    texts = F.transform_values(F.map_filter("_typed", lambda _, v: v["n"].isNull() & v["ms"].isNull()), lambda _, v: v["c"])
    maps = [of("n").alias("numbers"), of("ms").alias("times"), texts.alias("texts"), of("c").alias("others")]
    return rows.select("file_id", "campaign_id", "line_no", *[column(n, k).alias(n) for n, k in columns.items()], *maps)
