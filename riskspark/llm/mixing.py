"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import broadcast_within, materialize

NON_SPACE = r"[^\x20\x09-\x0D]+"
#: Documents that the last, sequential choice of a pattern looks at, on average.
BUCKET_DOCS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(NON_SPACE), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: Sequence[int], weights: Sequence[float], total: float, max_repeats: float = 2.0) -> list[float]:
    """Shares of total by weight, none above max_repeats times its size; the excess is reshared by weight."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        scale = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * scale >= max_repeats * sizes[i]]
        if not full:
            for i in open_:
                target[i] = weights[i] * scale
            break
        for i in full:
            target[i] = max_repeats * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def _levels(supply: list[int], members: Sequence[Sequence[int]], users: list[dict[int, None]], rest: list[int]) -> tuple[list[int], list[int]] | None:
    """Distances of patterns and sources from patterns with supply; None if no source with room is reached."""
    at_p, at_s = [-1] * len(supply), [-1] * len(rest)
    queue, found = deque(i for i, x in enumerate(supply) if x > 0), False
    for i in queue:
        at_p[i] = 0
    while queue:
        i = queue.popleft()
        for j in members[i]:
            if at_s[j] < 0:
                at_s[j] = at_p[i] + 1
                found |= rest[j] > 0
                for k in () if found else users[j]:
                    if at_p[k] < 0:
                        at_p[k] = at_s[j] + 1
                        queue.append(k)
    return (at_p, at_s) if found else None


def route(pattern_sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], max_repeats: int = 2) -> dict[tuple[int, int], int]:
    """Words that each pattern gives to each source: the cheapest largest flow.

    A pattern offers its size once at cost 1, a second time at cost 2, and so on up to max_repeats (convex costs), so no words
    are repeated while fresh ones can fill the same quota. A path's cost is that of the repetition it starts with, so cheapest paths first
    means: a largest flow with the first repetition's words, then augmented with the second's, and so on, each by blocking
    flows along shortest paths.
    """
    flow: list[dict[int, int]] = [{} for _ in pattern_sizes]
    users: list[dict[int, None]] = [{} for _ in quotas]  # patterns that give words to a source
    rest, supply = list(quotas), [0] * len(pattern_sizes)
    for _ in range(max_repeats):
        supply = [x + s for x, s in zip(supply, pattern_sizes, strict=True)]
        while found := _levels(supply, members, users, rest):
            at_p, at_s = found
            next_s = [iter(m) for m in members]
            next_p = [iter(list(u)) for u in users]
            for root in [i for i, x in enumerate(supply) if x > 0]:
                path = [root]  # patterns and sources in turn
                while path and supply[root] > 0:
                    here = path[-1]
                    if len(path) % 2:
                        step = next((j for j in next_s[here] if at_s[j] == at_p[here] + 1), None)
                    elif rest[here] > 0:
                        taken = [(path[n], path[n + 1]) for n in range(0, len(path), 2)]
                        back = [(path[n + 1], path[n]) for n in range(1, len(path) - 1, 2)]
                        push = min(supply[root], rest[here], *(flow[k][j] for k, j in back))
                        supply[root] -= push
                        rest[here] -= push
                        for i, j in taken:
                            flow[i][j] = flow[i].get(j, 0) + push
                            users[j][i] = None
                        for k, j in back:
                            flow[k][j] -= push
                            if not flow[k][j]:
                                del flow[k][j], users[j][k]
                        path = [root]
                        next_s[root] = iter(members[root])
                        continue
                    else:
                        step = next((k for k in next_p[here] if at_p[k] == at_s[here] + 1 and flow[k].get(here)), None)
                    if step is None:
                        path.pop()
                    else:
                        path.append(step)
    return {(i, j): w for i, own in enumerate(flow) for j, w in own.items()}


def _fill(table: pa.Table) -> pa.Table:
    """In the last bucket of a pattern: take documents in seeded order while they still fit the room left."""
    d = table.to_pydict()
    order = sorted(range(table.num_rows), key=lambda i: (d["_mx_hash"][i], d["_mx_id"][i], d["_mx_size"][i]))
    room = d["_mx_room"][0] if order else 0
    extra = np.zeros(table.num_rows, np.int64)
    for i in order:
        if d["_mx_size"][i] > 0:
            extra[i] = min(d["_mx_n"][i], room // d["_mx_size"][i])
            room -= int(extra[i]) * d["_mx_size"][i]
    return table.select(["_mx_key", "_mx_id", "_mx_size", "_mx_n"]).append_column("_mx_extra", pa.array(extra))


def mix(
    docs: DataFrame,
    membership: str = "sources",
    size: str = "size",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    seed: int = 17,
) -> DataFrame:
    """Choose how often each document is taken so that every source comes near its share of the mix.

    docs has a membership column (array of source names; null names allowed) and a size column (long). Sources sorted by code
    point, null last, weigh as `weights`, repeating. Added columns: source_size and target (of the document's first
    source in that order), copies (int, whole passes of the document, at most max_repeats) and taken = copies * size.

    Documents are summed by membership pattern; a min-cost flow routes the patterns' words to the source quotas with costs that rise
    with each repetition. The driver holds a sum for each distinct source set, no documents. A pattern whose flow is f words of s takes every document f div s times and
    a seeded choice once more: documents fall into hash buckets in seeded order, whole buckets are taken by a prefix
    sum over bucket totals, and the bucket where the sum is reached is filled document by document; documents alike in doc_id
    and size are one line with a count there, so no bucket grows with repeats. Reruns agree: the order depends on doc_id, size and seed alone.

    Documents of size 0, of null size or without sources are never taken (copies 0). Repeated rows are separate documents. Null doc_ids
    are ids like others. An empty input gives an empty result. Other columns stay; columns with the added names are replaced, those starting
    with `_mx_` are reserved.
    """
    spark = docs.sparkSession
    docs = docs.drop("source_size", "target", "copies", "taken")
    key = F.sort_array(F.array_distinct(F.transform(F.coalesce(F.col(membership), F.array().cast("array<string>")), lambda x: F.struct(x.isNull().alias("n"), x.alias("s")))))
    written = docs.withColumns({
        "_mx_key": F.to_json(key), "_mx_size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "_mx_first": F.get(key, 0),
        "_mx_id": F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), "_mx_row": F.monotonically_increasing_id(),
    })
    written = materialize(written, "mix-rows")
    slim = written.select("_mx_row", "_mx_key", "_mx_id", "_mx_size")

    rows = slim.groupBy("_mx_key").agg(F.sum("_mx_size").alias("size"), F.count("*").alias("docs")).withColumn("of", F.from_json("_mx_key", "array<struct<n:boolean,s:string>>")).collect()  # one for each source set
    rows.sort(key=lambda r: r["_mx_key"])
    names = sorted({(bool(x["n"]), x["s"] or "") for r in rows for x in r["of"]})
    index = {x: i for i, x in enumerate(names)}
    members = [[index[bool(x["n"]), x["s"] or ""] for x in r["of"]] for r in rows]
    sizes = [0] * len(names)
    for r, own in zip(rows, members, strict=True):
        for j in own:
            sizes[j] += r["size"]
    total = sum(r["size"] for r in rows)
    target = source_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * total, max_repeats) if names else []
    flow = route([r["size"] for r in rows], members, [round(t) for t in target], max_repeats)

    words = [0] * len(rows)
    for (i, _), w in flow.items():
        words[i] += w
    plan = []
    for r, given in zip(rows, words, strict=True):
        base, rest = divmod(given, r["size"]) if r["size"] else (0, 0)
        plan.append((r["_mx_key"], int(base), int(rest), -(-r["docs"] // BUCKET_DOCS)))
    plan_df = broadcast_within(spark.createDataFrame(plan, "_mx_key string, _mx_base int, _mx_rest long, _mx_buckets long"), 64 + F.octet_length("_mx_key"))
    facts = broadcast_within(spark.createDataFrame([(n, None if n else s, int(sizes[i]), float(target[i])) for (n, s), i in index.items()], "_mx_n boolean, _mx_s string, source_size long, target double"), 64 + F.coalesce(F.octet_length("_mx_s"), F.lit(0)))

    line = ["_mx_key", "_mx_id", "_mx_size"]
    order = F.xxhash64(F.lit(seed), "_mx_id", "_mx_size")
    planned = slim.join(plan_df, "_mx_key").withColumn("_mx_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), order), F.col("_mx_buckets")))
    lines = planned.where("_mx_rest > 0").groupBy(*line, "_mx_bucket").agg(F.count("*").alias("_mx_n"), F.first("_mx_rest").alias("_mx_rest"))
    lines = materialize(lines, "mix-lines")
    cells = lines.groupBy("_mx_key", "_mx_bucket").agg(F.sum(F.col("_mx_size") * F.col("_mx_n")).alias("_mx_words"), F.first("_mx_rest").alias("_mx_rest"))
    running = Window.partitionBy("_mx_key").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row for BUCKET_DOCS documents
    cells = cells.withColumn("_mx_upto", F.sum("_mx_words").over(running))
    edge = F.expr("_mx_upto > _mx_rest and _mx_upto - _mx_words < _mx_rest")
    cells = cells.select("_mx_key", "_mx_bucket", F.expr("_mx_upto <= _mx_rest").alias("_mx_whole"), F.when(edge, F.expr("_mx_rest - (_mx_upto - _mx_words)")).alias("_mx_room"))
    cells = materialize(cells, "mix-buckets")
    last = lines.join(cells.where("_mx_room is not null").drop("_mx_whole"), ["_mx_key", "_mx_bucket"]).withColumn("_mx_hash", order)
    extra = materialize(last.groupBy("_mx_key", "_mx_bucket").applyInArrow(_fill, "_mx_key string, _mx_id string, _mx_size long, _mx_n long, _mx_extra long"), "mix-last").where("_mx_extra > 0")
    placed = planned.join(broadcast_within(cells.drop("_mx_room"), 64 + F.octet_length("_mx_key")), ["_mx_key", "_mx_bucket"], "left").join(broadcast_within(extra, 96 + F.octet_length("_mx_key")), line, "left")

    # of a line's rows, the first _mx_extra in the order of the rows: their place is a place among the task's rows plus a prefix sum over tasks
    parted = placed.where("_mx_extra < _mx_n").select(*line, "_mx_row", F.shiftright("_mx_row", 33).alias("_mx_part"))
    parts = parted.groupBy(*line, "_mx_part").agg(F.count("*").alias("_mx_held"))
    before = Window.partitionBy(*line).orderBy("_mx_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_mx_before", F.coalesce(F.sum("_mx_held").over(before), F.lit(0))).drop("_mx_held")
    nth = F.row_number().over(Window.partitionBy(*line, "_mx_part").orderBy("_mx_row"))
    nth = parted.withColumn("_mx_nth", nth).join(parts, [*line, "_mx_part"]).select("_mx_row", (F.col("_mx_nth") + F.col("_mx_before")).alias("_mx_nth"))
    more = placed.join(nth, "_mx_row", "left").withColumn("_mx_more", F.coalesce("_mx_whole", F.lit(False)) | F.coalesce(F.col("_mx_extra") >= F.coalesce("_mx_nth", F.col("_mx_n")), F.lit(False)))
    copies = F.when(F.col("_mx_size") == 0, 0).otherwise(F.col("_mx_base") + F.col("_mx_more").cast("int")).cast("int")
    out = written.join(more.select("_mx_row", copies.alias("copies")), "_mx_row")
    out = out.join(facts, (F.col("_mx_first.n") == F.col("_mx_n")) & F.col("_mx_first.s").eqNullSafe(F.col("_mx_s")), "left")
    out = out.withColumn("taken", F.col("copies") * F.col("_mx_size"))
    return out.drop(*[c for c in out.columns if c.startswith("_mx_")])
