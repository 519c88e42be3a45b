"""Operators that are sequential by nature, as Arrow functions: per query, per document or per community."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions import text as X

def diversify(ids: np.ndarray, rel: np.ndarray, x: np.ndarray, k: int, lam: float) -> list[int]:
    """Maximal marginal relevance: the order in which k of the rows are picked; the rest follows as it was.

    ``rel`` descends; the first row is always first; each pick maximises lam * rel / max - (1 - lam) * closest picked.
    """
    n = len(ids)
    if n == 0:
        return []
    norm = np.sqrt((x * x).sum(1))
    u = x / np.where(norm > 0, norm, 1)[:, None]
    r = rel / rel.max() if rel.max() > 0 else rel
    picked, closest = [0], u @ u[0]
    free = np.ones(n, bool)
    free[0] = False
    while len(picked) < min(k, n):
        s = np.where(free, np.round(lam * r - (1 - lam) * closest, 9), -np.inf)
        best = int(np.argmax(s))
        picked.append(best)
        free[best] = False
        closest = np.maximum(closest, u @ u[best])
    return picked + [i for i in range(n) if free[i]]


def mmr(hits: DataFrame, k: int = 10, lam: float = 0.7) -> DataFrame:
    """(query_id, id, rank) of hits (query_id, id, relevance, vec) put in a diverse order, one query at a time.

    A query's hits are a top-k result and therefore bounded.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "id"], ascending=[False, True])
        order = diversify(pdf["id"].to_numpy(), pdf["relevance"].to_numpy(float), np.array(pdf["vec"].tolist(), dtype=float), k, lam)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[order].to_numpy(), "id": pdf["id"].iloc[order].to_numpy(), "rank": np.arange(1, len(order) + 1)})

    return hits.groupBy("query_id").applyInPandas(one, "query_id long, id long, rank long")


def mmr_of_lists(hits: DataFrame, reach: DataFrame, lists: DataFrame, vectors: DataFrame, k: int = 10, lam: float = 0.7, queries: int = 512) -> DataFrame:
    """(query_id, id, relevance, rank): the first ``k`` of ``mmr`` over hits (query_id, id, relevance) and the rows of whole lists.

    reach: the lists that a query gets beside its hits, and their relevance (query_id, kind, relevance); lists: (kind, id).
    A row of a list that is a hit of the query anyhow counts as the hit.  Queries that get the same lists meet them about
    ``queries`` at a time, so that a list is shipped once for those and not to each.
    """
    gets = reach.groupBy("query_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).withColumn("combo", F.xxhash64("kinds"))
    salts = max(12, -(-gets.count() // queries))
    salt = F.pmod(F.xxhash64("query_id"), F.when(F.col("combo") == 0, 1 << 12).otherwise(salts)).alias("salt")
    of_query = gets.select("query_id", "combo")
    own = hits.join(of_query, "query_id", "left").withColumn("combo", F.coalesce("combo", F.lit(0).cast("long"))).join(vectors.select("id", "vec"), "id")
    own = own.select("combo", salt, "query_id", F.lit(False).alias("listed"), "id", "relevance", "vec")
    whole = reach.join(of_query, "query_id").select("combo", salt, "query_id", F.lit(True).alias("listed"), F.col("kind").alias("id"), "relevance", F.lit(None).cast(own.schema["vec"].dataType).alias("vec"))
    held = gets.select("combo", "kinds").distinct().select("combo", F.explode("kinds").alias("kind")).join(lists.join(vectors.select("id", "vec"), "id"), "kind")
    held = held.select("combo", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("list_salt"), "kind", "id", "vec")
    held = held.select(F.col("combo").alias("list_combo"), "list_salt", *[F.col(c).alias(f"list_{c}") for c in ("kind", "id", "vec")])

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_list()).astype(float)
        return x / np.sqrt((x * x).sum(1))[:, None]

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        list_id, list_kind = right["list_id"].to_numpy(), right["list_kind"].to_numpy()
        list_u, out = unit(right["list_vec"]) if len(right) else None, []
        for q, g in left.groupby("query_id"):
            mine, got = g[~g["listed"]], g[g["listed"]]
            ids, rel, parts = mine["id"].to_numpy(), mine["relevance"].to_numpy(float), [unit(mine["vec"])] if len(mine) else []
            free = np.ones(len(ids), bool)
            if len(got) and len(right):
                of_list = np.full(len(list_id), -np.inf)
                for kind, r in zip(got["id"], got["relevance"], strict=True):
                    of_list[list_kind == kind] = r
                free = np.concatenate([free, np.isfinite(of_list) & ~np.isin(list_id, ids)])
                ids, rel, parts = np.concatenate([ids, list_id]), np.concatenate([rel, of_list]), [*parts, list_u]
            if not free.any():
                continue
            best_rel = rel[free].max()
            r = np.where(free, rel / best_rel if best_rel > 0 else rel, 0)
            s, closest, starts = np.where(free, rel, -np.inf), None, np.cumsum([0, *(len(p) for p in parts)])
            for rank in range(1, min(k, int(free.sum())) + 1):
                if closest is not None:
                    s = np.where(free, np.round(lam * r - (1 - lam) * closest, 9), -np.inf)
                tied = np.flatnonzero(s == s.max())
                best = tied[np.lexsort((ids[tied], -rel[tied]))[0]]
                free[best] = False
                out.append((q, ids[best], rel[best], rank))
                part = int(np.searchsorted(starts, best, side="right")) - 1
                near = np.concatenate([p @ parts[part][best - starts[part]] for p in parts])
                closest = near if closest is None else np.maximum(closest, near)
        return pd.DataFrame(out, columns=["query_id", "id", "relevance", "rank"])

    both = own.unionByName(whole).groupBy("combo", "salt").cogroup(held.groupBy("list_combo", "list_salt"))
    return both.applyInPandas(pick, "query_id long, id long, relevance double, rank long")


def fitting_runs(lengths: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(first, count) of the runs into which items of these lengths go, joined by one character, at most ``size`` each.

    A run takes all items that fit; an item that is longer by itself forms a run of its own.  Running sums say where a
    run must end, so that every run takes one binary search.
    """
    upto = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64) + 1)])
    out, first = [], 0
    while first < len(lengths):
        last = int(np.searchsorted(upto, upto[first] + size + 1, side="right")) - 1
        last = max(last, first + 1)
        out.append((first, last - first))
        first = last
    return out


def _runs(lengths: Column, size: int) -> Column:
    @F.pandas_udf("array<struct<first: int, count: int>>")
    def runs(s: pd.Series) -> pd.Series:
        return pd.Series([[{"first": a, "count": n} for a, n in fitting_runs(x, size)] for x in s])

    return runs(lengths)


def _bridge(before: Column, chunk: Column, overlap: int, size: int) -> Column:
    """What a chunk repeats of the one before: whole words of its last ``overlap`` characters, fewer if the chunk begins with them anyhow."""
    reach = min(overlap, max(1, size // 2))
    tail = F.right(before, F.lit(reach))
    blank = F.instr(tail, " ")
    usual = F.when(blank > 1, F.substr(tail, blank + 1)).otherwise(tail)
    quarter = F.right(before, F.greatest(F.lit(1), F.floor(F.char_length(before) / 4).cast("int")))
    at = F.instr(F.trim(quarter), " ")
    short = F.when(at > 0, F.substr(quarter, at + 1)).otherwise(quarter)
    return F.when(F.trim(tail) == F.trim(F.left(chunk, F.lit(reach))), short).otherwise(usual)


def sentence_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_no, n_chunks, chunk) of every text; null and blank texts have none.

    Chunks are runs of whole sentences of at most ``size`` characters, a longer sentence is a chunk of its own, and each
    chunk but the first begins with the last words of the one before.  Texts of at most ``size`` characters stay whole.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.trim(text) != "")
    parts = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    rows = rows.withColumn("parts", F.when(F.char_length(text) <= size, F.array(text)).otherwise(parts))
    runs = rows.withColumn("runs", _runs(F.transform("parts", lambda s: F.char_length(s)), size))
    whole = runs.withColumn("whole", F.transform("runs", lambda r: F.array_join(F.slice("parts", r["first"] + 1, r["count"]), " ")))
    linked = F.transform("whole", lambda c, i: F.when(i == 0, c).otherwise(F.trim(F.concat(_bridge(F.get("whole", F.greatest(i - 1, F.lit(0))), c, overlap, size), F.lit(" "), c))))
    if overlap <= 0:
        linked = F.col("whole")
    return whole.select("id", F.size("whole").cast("long").alias("n_chunks"), F.posexplode(linked).alias("no", "chunk")).select("id", (F.col("no") + 1).cast("long").alias("chunk_no"), "n_chunks", "chunk")


FACT = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("predicate", T.StringType()), T.StructField("value", T.StringType()), T.StructField("text", T.StringType())]))
#: Keys of bullets that state nothing.
EMPTY_KEYS = frozenset(("note", "here", "for example", "tip", "warning", "important"))
_MEASURED, _NAMED = re.compile(X.NUMERIC_FACT), re.compile(X.PROPER_NAME)


def is_atomic(text: str) -> bool:
    """``functions.text.atomic`` for one text."""
    t = text.strip()
    return 4 <= len(t) <= 280 and (t.lower().startswith(("user ", "the user ")) or bool(_MEASURED.search(t) or _NAMED.search(t)))


def bold_at(text: str, at: int) -> tuple[str, int] | None:
    """The bold words that open at ``at`` and the place after them."""
    end = text.find("*", at + 2)
    return (text[at + 2 : end], end + 2) if text.startswith("**", at) and end > at + 2 and text.startswith("**", end) else None


def bullet(line: str) -> tuple[bool, str, str] | None:
    """(bold key?, key, value) of a line "- **Key**: value" or "- Key: value"; a plain key is 3 to 62 letters and blanks from a capital on."""
    if line[:1] not in ("-", "*", "+") or not line[1:2].isspace():
        return None
    body = line[1:].strip()
    if strong := bold_at(body, 0):
        key, rest = strong[0], body[strong[1] :].lstrip()
        return (True, key.strip(), rest[1:].strip()) if rest.startswith(":") and rest[1:].strip() else None
    key, colon, value = body.partition(":")
    key = key.rstrip()
    letters = key.replace(" ", "").replace("\t", "")
    plain = 3 <= len(key) <= 62 and letters.isascii() and letters.isalpha() and key[0].isupper() and key[1].isalpha()
    return (False, key, value.strip()) if plain and colon and value[:1].isspace() and value.strip() else None


def heading(line: str) -> str | None:
    """The entity of a heading of level 2 to 6 that is all bold."""
    level = len(line) - len(line.lstrip("#"))
    body = line[level:].strip()
    strong = bold_at(body, 0) if 2 <= level <= 6 and line[level : level + 1].isspace() else None
    return strong[0].strip() if strong and strong[1] == len(body) else None


def assignments(text: str) -> Iterator[tuple[str, str]]:
    """(bold words, what stands after the colon or dash that follows them up to the end of the clause)."""
    at = 0
    while (at := text.find("**", at)) >= 0:
        strong = bold_at(text, at)
        rest = text[strong[1] : strong[1] + 400].lstrip() if strong else ""
        if not strong or rest[:1] not in (":", "-") or not rest[1:2].isspace():
            at += 1
            continue
        begin = text.index(rest[0], strong[1]) + 1
        end = min((e for c in ".;\n" if (e := text.find(c, begin + len(text[begin:]) - len(text[begin:].lstrip()))) >= 0), default=len(text))
        value = text[begin:end].strip()
        if value:
            yield strong[0].strip(), value
        at = max(end, at + 1) if value else at + 1


def facts_of(text: str | None) -> list[tuple]:
    """Atomic facts of a markdown text as (entity, predicate, value, text), each text once: bullets with a bold key, then
    with a plain key, both under the last all-bold heading, then bold words with a value that no bullet has as entity."""
    lines = (text or "").split("\n")
    entity, bullets = None, []
    for line in lines:
        entity = heading(line) or entity
        if b := bullet(line):
            bullets.append((entity, *b))
    found = [(e, k, v, ", ".join(x for x in (e, f"{k}: {v}") if x)) for bold in (True, False) for e, is_bold, k, v in bullets if is_bold == bold and (bold or k.lower() not in EMPTY_KEYS)]
    found = [f for f in found if is_atomic(f[3])]
    known = {f[0] for f in found}
    for e, v in assignments(text or ""):
        if e not in known and is_atomic(f"{e}: {v}"):
            known.add(e)
            found.append((e, None, v, f"{e}: {v}"))
    once = {}
    for f in found:
        once.setdefault(f[3].lower(), f)
    return list(once.values())


def markdown_facts(text: Column) -> Column:
    @F.pandas_udf(FACT)
    def facts(s: pd.Series) -> pd.Series:
        return pd.Series([facts_of(t) for t in s], dtype=object)

    return facts(text)


def louvain_sweeps(nodes: list, adjacency: dict, sweeps: int = 10, least: float = 1e-6) -> dict:
    """One level of Louvain in ascending order of nodes, ties to the smallest label: deterministic."""
    label = {n: n for n in nodes}
    k = {n: sum(adjacency[n].values()) for n in nodes}
    total = dict(k)
    m2 = sum(k.values())
    if not m2:
        return label
    for _ in range(sweeps):
        moved = False
        for n in nodes:
            own = label[n]
            total[own] -= k[n]
            links: dict = {own: 0.0}
            for o, w in adjacency[n].items():
                if o != n:
                    links[label[o]] = links.get(label[o], 0.0) + w
            stay = links[own] - k[n] * total[own] / m2
            best, gain = own, stay
            for c in sorted(links):
                g = links[c] - k[n] * total[c] / m2
                if g > gain + least:
                    best, gain = c, g
            label[n] = best
            total[best] = total.get(best, 0.0) + k[n]
            moved |= best != own
        if not moved:
            break
    return label


def louvain(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, label): communities of the simple graph ``pairs`` (a, b, w), found within each connected component (id, root).

    Modularity never joins nodes of different components, so components are independent tasks.  A component is held by
    one task as an adjacency list of numbers; label propagation (operators.graph) is the distributed way for giant ones.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict = {}
        for a, b, w in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist(), strict=True):
            adjacency.setdefault(a, {})[b] = adjacency.get(a, {}).get(b, 0.0) + w
            adjacency.setdefault(b, {})[a] = adjacency.get(b, {}).get(a, 0.0) + w
        label = louvain_sweeps(sorted(adjacency), adjacency)
        first: dict = {}
        for n in sorted(label):
            first.setdefault(label[n], n)
        return pd.DataFrame({"id": list(label), "label": [first[x] for x in label.values()]})

    placed = pairs.join(roots.select(F.col("id").alias("a"), "root"), "a").select("root", "a", "b", "w")
    return placed.groupBy("root").applyInPandas(one, "id long, label long")
