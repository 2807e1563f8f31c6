"""Scoring kernels: type matching, listing differences and graph edit distance, as vectorised Python over one row's structures."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of types and what they stand for.
TYPE_NAMES = {
    "undefined8": "long long",
    "undefined4": "int",
    "undefined2": "short",
    "undefined1": "char",
    "undefined": "char",
    "__int64": "long long",
    "__int32": "int",
    "__int16": "short",
    "__int8": "char",
    "_QWORD": "long long",
    "_DWORD": "int",
    "_WORD": "short",
    "_BYTE": "char",
    "_BOOL": "bool",
    "int1": "char",
    "int2": "short",
    "int4": "int",
    "int8": "long long",
    "uint1": "char",
    "uint2": "short",
    "uint4": "int",
    "uint8": "long long",
    "uint": "int",
    "ulong": "long long",
    "long": "long long",
    "ushort": "short",
    "uchar": "char",
    "uint64_t": "long long",
    "uint32_t": "int",
    "uint16_t": "short",
    "uint8_t": "char",
    "int64_t": "long long",
    "int32_t": "int",
    "int16_t": "short",
    "int8_t": "char",
    "size_t": "long long",
    "ssize_t": "long long",
}
#: Qualifiers that don't count, and longer spellings of the same type.
QUALIFIERS = ("unsigned", "signed", "const", "volatile", "register", "static", "extern")
SAME = (("long long int", "long long"), ("long int", "long long"), ("short int", "short"), ("_Bool", "bool"), ("Bool", "bool"), ("boolean", "bool"))
#: Scalars of a width, and spellings that only say a width.
SCALARS = {1: {"char", "bool"}, 2: {"short"}, 4: {"int"}, 8: {"long long"}}
WORD_WIDTHS = {"undefined": 1, "byte": 1, "uchar": 1, "_BYTE": 1, "word": 2, "_WORD": 2, "dword": 4, "_DWORD": 4, "qword": 8, "_QWORD": 8}
#: Families of such spellings with a number, how many of its units a byte has, and the numbers that occur.
NUMBERED = {"undefined": (1, range(100)), "__int": (8, (8, 16, 32, 64)), "__uint": (8, (8, 16, 32, 64)), "int": (1, range(1, 9)), "uint": (1, range(1, 9))}
#: Nodes from which graph distances are bounded by sizes instead of computed.
GED_NODES = 60

VARIABLE = "struct<name:string,type:string,stack_offset:int,size:int,kind:string,arg_index:int>"
TRUTH = "struct<name:string,type:array<string>,offsets:array<int>,is_arg:boolean,arg_index:int>"
TYPE_SCORE = "value double, tp int, fp int, fn int, shift int, by_arg int, by_offset int, by_name int"


def _restated(form: str) -> set[str]:
    """What one rule makes of a spelling: a plain name for it, no qualifiers, a shorter spelling, single spaces, stars at the name."""
    words = [w for w in form.split() if w not in QUALIFIERS]
    shorter = {form.replace(long, short) for long, short in SAME}
    return {TYPE_NAMES.get(form, form), " ".join(words), "*".join(p.rstrip() for p in form.split("*"))} | shorter


def type_forms(spelling: str | None) -> set[str]:
    """Equivalent spellings of a C type, closed under the rules; two types match if they share one."""
    out: set[str] = set()
    fresh = {" ".join((spelling or "").split())}
    while fresh := fresh - out - {""}:
        out |= fresh
        fresh = set().union(*map(_restated, fresh))
    return out


def bare_width(spelling: str | None, size: int | None) -> int | None:
    """Bytes of a type that only says its width; pointers are committed types."""
    text = (spelling or "").strip()
    family = text.rstrip("0123456789")
    units, numbers = NUMBERED.get(family, (1, ()))
    number = text[len(family) :]
    if text in WORD_WIDTHS:
        width = WORD_WIDTHS[text]
    elif number and int(number) in numbers:
        width = int(number) // units
    else:
        return None
    return next((w for w in (size, width) if w in SCALARS), None)


def slot(name: str | None, offset: int | None) -> int | None:
    if offset is not None:
        return int(offset)
    m = re.fullmatch(r"(?:local|var)_([0-9a-fA-F]+)", name or "")
    return -int(m[1], 16) if m else None


def _best(candidates: Iterable[int], votes) -> tuple[int | None, int]:
    best, most = None, 0
    for k in candidates:
        v = votes(k)
        if v > most:
            best, most = k, v
    return best, most


def function_shift(truth: list[int], found: list[int]) -> int | None:
    """The shift under which most distinct slots of one function coincide; a lone coincidence doesn't count as one."""
    counts = Counter(g - d for g in set(truth) for d in set(found))  # a shift's coincidences are the differences equal to it
    if not counts:
        return None
    shift = min(counts, key=lambda k: (-counts[k], abs(k), k))
    if shift == 0 or counts[shift] > 1 or len(found) == 1:
        return shift
    return 0 if counts[0] else None


def binary_shift(pairs: list[tuple[list[int], list[int]]], reach: int = 32) -> int | None:
    """One shift for a binary: each function votes with its coincidences but one; without any such vote, with all, guarded."""
    pairs = [(set(g), set(d)) for g, d in pairs if len(g) and len(d)]
    near = sorted(range(-reach, reach + 1), key=lambda k: (abs(k), k))
    hits = lambda g, d, k: sum(x + k in g for x in d)
    k, _ = _best(near, lambda k: sum(max(0, hits(g, d, k) - 1) for g, d in pairs))
    if k is not None:
        return k
    k, most = _best(near, lambda k: sum(hits(g, d, k) for g, d in pairs))
    if k:
        return 0 if sum(hits(g, d, 0) for g, d in pairs) else (k if most > 1 else None)
    return k


def type_match(truth: list[dict], found: list[dict], shift: int | None = None) -> dict:
    """Match true variables to recovered ones: arguments by position, slots by shifted offset, the rest by name. Each is used once."""
    offsets = [o for t in truth for o in (t["offsets"] if t["offsets"] is not None else ())]
    slots = [slot(v["name"], v["stack_offset"]) for v in found]
    placed = [s for s in slots if s is not None]
    shift = shift or 0
    own = function_shift(offsets, placed)
    fits = lambda k: len({p + k for p in placed} & set(offsets))
    if own is not None and not fits(shift) and fits(own):
        shift = own
    forms = [type_forms(v["type"]) for v in found]
    widths = [bare_width(v["type"], v["size"]) for v in found]
    args: dict[int, int] = {}
    places, names = defaultdict(list), defaultdict(list)
    for i, v in enumerate(found):
        if v["arg_index"] is not None:
            args.setdefault(v["arg_index"], i)
        if slots[i] is not None:
            places[slots[i] + shift].append(i)
        if v["name"]:
            names[v["name"]].append(i)
    free, verdict = set(range(len(found))), {}
    count = {"arg": 0, "offset": 0, "name": 0}

    def settle(how: str, g: int, options: list[int]) -> None:
        options = [i for i in options if i in free]
        if g in verdict or not options:
            return
        want = set(truth[g]["type"] if truth[g]["type"] is not None else ())
        right = [i for i in options if want & forms[i] or want & SCALARS.get(widths[i], set())]
        free.discard((right or options)[0])
        verdict[g] = bool(right)
        count[how] += 1

    for g, t in enumerate(truth):
        if t["is_arg"] and t["arg_index"] in args:
            settle("arg", g, [args[t["arg_index"]]])
    for g, t in enumerate(truth):
        settle("offset", g, [i for o in (t["offsets"] if t["offsets"] is not None else ()) for i in places.get(o, ())])
    for g, t in enumerate(truth):
        settle("name", g, names.get(t["name"], []) if t["name"] else [])
    tp = sum(verdict.values())
    fp, fn = len(verdict) - tp, len(truth) - len(verdict)
    total = tp + fp + fn
    return {"value": tp / total if total else 0.0, "tp": tp, "fp": fp, "fn": fn, "shift": shift, **{f"by_{k}": v for k, v in count.items()}}


def _plain(rows) -> list[dict]:
    """Dicts without pandas' floats for missing integers."""
    clean = lambda x: None if isinstance(x, float) and x != x else x
    return [] if rows is None else [{k: clean(v) for k, v in r.items()} for r in rows]


def type_match_udf():
    """Column function (truth, variables, binary shift) -> score struct."""

    @F.pandas_udf(TYPE_SCORE)
    def score(truth: pd.Series, found: pd.Series, shift: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([type_match(_plain(t), _plain(f), None if pd.isna(s) else int(s)) for t, f, s in zip(truth, found, shift, strict=True)])

    return score


def elect_shift(slots: DataFrame, reach: int = 32) -> DataFrame:
    """(group, shift) by votes, without Python: slots holds group, fn_id, truth and found (offsets as arrays).

    A function's candidates are the differences of its offsets, and a candidate's coincidences how
    often it is one; 0 is always a candidate. Votes are summed by candidate before the shuffle.
    """
    rows = slots.where((F.size("truth") > 0) & (F.size("found") > 0))
    gaps = F.flatten(F.transform(F.array_distinct("truth"), lambda t: F.transform(F.array_distinct("found"), lambda d: t - d)))
    rows = rows.select("group", F.filter(gaps, lambda k: F.abs(k) <= reach).alias("gaps"))
    rows = rows.select("group", "gaps", F.explode(F.array_union("gaps", F.array(F.lit(0)))).alias("k"))
    hit = F.size(F.filter("gaps", lambda x: x == F.col("k")))
    votes = rows.groupBy("group", "k").agg(F.sum(F.greatest(F.lit(0), hit - 1)).alias("many"), F.sum(hit).alias("all"))
    rank = F.struct(-F.abs("k"), -F.col("k"))
    best = votes.groupBy("group").agg(F.max_by(F.struct("k", "many"), F.struct("many", rank)).alias("m"), F.max_by(F.struct("k", "all"), F.struct("all", rank)).alias("a"), F.max(F.when(F.col("k") == 0, F.col("all"))).alias("zero"))
    alone = F.when(F.col("a.all") == 0, None).when((F.col("a.k") != 0) & (F.col("zero") > 0), 0).when((F.col("a.k") != 0) & (F.col("a.all") < 2), None).otherwise(F.col("a.k"))
    return best.select("group", F.when(F.col("m.many") > 0, F.col("m.k")).otherwise(alone).alias("shift"))


def line_diff(a: list[str], b: list[str]) -> tuple[float, int]:
    """(shared / all, changed) lines by a longest common subsequence, in Myers' greedy form: time grows with the differences."""
    n, m = len(a), len(b)
    if not n and not m:
        return 1.0, 0
    if not n or not m:
        return 0.0, n + m
    reach = {1: 0}
    for d in range(n + m + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                shared = (n + m - d) // 2
                return shared / (shared + d), d
    raise AssertionError


def line_diff_udf():
    @F.pandas_udf("like double, changed int")
    def diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line_diff(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["like", "changed"])

    return diff


def _assign(cost: list[list[float]]) -> list[int]:
    """Columns of rows in a cheapest perfect matching (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[j0]:
            done[j0], i0, step, j1 = True, match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not done[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < step:
                        step, j1 = low[j], j
            for j in range(n + 1):
                if done[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    low[j] -= step
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def _graph(nodes: list[int], edges: list[tuple[int, int]]):
    index = {x: i for i, x in enumerate(dict.fromkeys(nodes))}
    succ = [set() for _ in index]
    pred = [set() for _ in index]
    for a, b in edges:
        succ[index[a]].add(index[b])
        pred[index[b]].add(index[a])
    return succ, pred


def _isomorphic(g, h) -> bool:
    """Exact test: colours are refined by neighbours' colours, then nodes are mapped within colours with backtracking."""
    (sg, pg), (sh, ph) = g, h
    n = len(sg)
    if n != len(sh) or sum(map(len, sg)) != sum(map(len, sh)):
        return False
    cg, ch = [0] * n, [0] * n
    for _ in range(n):
        kg = [(cg[i], tuple(sorted(cg[j] for j in sg[i])), tuple(sorted(cg[j] for j in pg[i]))) for i in range(n)]
        kh = [(ch[i], tuple(sorted(ch[j] for j in sh[i])), tuple(sorted(ch[j] for j in ph[i]))) for i in range(n)]
        names = {k: c for c, k in enumerate(sorted(set(kg) | set(kh)))}
        ng, nh = [names[k] for k in kg], [names[k] for k in kh]
        if sorted(ng) != sorted(nh):
            return False
        if len(set(ng)) == len(set(cg)):
            break
        cg, ch = ng, nh
    size = defaultdict(int)
    for c in cg:
        size[c] += 1
    order = sorted(range(n), key=lambda i: (size[cg[i]], cg[i]))
    to: dict[int, int] = {}
    used: set[int] = set()

    def place(k: int) -> bool:
        if k == n:
            return True
        i = order[k]
        for j in range(n):
            if j in used or ch[j] != cg[i]:
                continue
            if (i in sg[i]) != (j in sh[j]):
                continue
            if any((to[x] in sh[j]) != (x in sg[i]) or (to[x] in ph[j]) != (x in pg[i]) for x in to):
                continue
            to[i] = j
            used.add(j)
            if place(k + 1):
                return True
            del to[i]
            used.discard(j)
        return False

    return place(0)


def graph_distance(a_nodes, a_edges, b_nodes, b_edges, most: int = GED_NODES) -> float:
    """Edits between two flow graphs: 0 if and only if isomorphic, the difference of sizes beyond ``most`` nodes.

    Between: nodes are assigned so that parents' and children's counts, and being an entry or exit,
    differ least; exchanges improve the mapping, and the edits are those that it and its edges need.
    No source graph: infinite.
    """
    if not len(a_nodes):
        return float("inf")
    a_edges, b_edges = {tuple(e) for e in a_edges}, {tuple(e) for e in b_edges}
    if len(a_nodes) > most or len(b_nodes) > most:
        return float(abs(len(a_nodes) - len(b_nodes)) + abs(len(a_edges) - len(b_edges)))
    g, h = _graph(list(a_nodes), a_edges), _graph(list(b_nodes), b_edges)
    if _isomorphic(g, h):
        return 0.0
    n, m = len(g[0]), len(h[0])
    size = n + m
    cost = [[0.0] * size for _ in range(size)]
    for i in range(n):
        out, inn = len(g[0][i]), len(g[1][i])
        for j in range(m):
            o, p = len(h[0][j]), len(h[1][j])
            cost[i][j] = abs(out - o) + abs(inn - p) + ((not inn) != (not p)) + ((not out) != (not o))
        for j in range(n):
            cost[i][m + j] = 1 + out + inn if i == j else 1e9
    for j in range(m):
        for i in range(m):
            cost[n + i][j] = 1 + len(h[0][j]) + len(h[1][j]) if i == j else 1e9
    return float(max(1, _improved(_assign(cost)[:n], g, h)))


def _improved(to: list[int], g, h) -> int:
    """Edits of a node mapping (targets beyond ``h``: deleted), after exchanges that lower them."""
    n, m = len(g[0]), len(h[0])
    edges = sum(map(len, g[0])) + sum(map(len, h[0]))

    def edits() -> int:
        mapped = sum(t < m for t in to)
        kept = sum(to[i] < m and to[j] < m and to[j] in h[0][to[i]] for i in range(n) for j in g[0][i])
        return n + m - 2 * mapped + edges - 2 * kept

    best, better = edits(), True
    while better:
        better = False
        for i in range(n):
            for t in range(m):
                if to[i] == t:
                    continue
                k = to.index(t) if t in to else None
                old = to[i]
                to[i] = t
                if k is not None:
                    to[k] = old
                if (e := edits()) < best:
                    best, better = e, True
                else:
                    to[i] = old
                    if k is not None:
                        to[k] = t
    return best


def graph_distance_udf():
    @F.pandas_udf("double")
    def ged(an: pd.Series, ae: pd.Series, bn: pd.Series, be: pd.Series) -> pd.Series:
        pairs = lambda es: [tuple(e) for e in es]
        return pd.Series([float("inf") if a is None or c is None else graph_distance(a, pairs(b), c, pairs(d)) for a, b, c, d in zip(an, ae, bn, be, strict=True)])

    return ged


def graph_stats(nodes: Column, edges: Column) -> dict[str, Column]:
    """Size, cyclomatic number, density, entries, exits and mean out-degree of a graph (nodes array<int>, edges array<struct<u, v>>)."""
    n, e = F.size(nodes), F.size(edges)
    targets, starts = F.transform(edges, lambda x: x["v"]), F.transform(edges, lambda x: x["u"])
    return {
        "nodes": n,
        "edges": e,
        "size": n + e,
        "cyclomatic": e - n + 2,
        "density": F.when(n > 1, e / (n * (n - 1))).otherwise(F.lit(0.0)),
        "entries": F.size(F.array_except(nodes, targets)),
        "exits": F.size(F.array_except(nodes, starts)),
        "avg_out": F.when(n > 0, e / n).otherwise(F.lit(0.0)),
    }
