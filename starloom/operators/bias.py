"""What a search rewards: rows for having data at all, or for what the data says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.linear import BLOCK, TILE, met, numbers
from starloom.operators.ranks import PLACES, pair_scores

SCHEMA = "q long, flip int, item long, score double, shown boolean, near boolean, near_n long, near_shown long, far_n long, far_shown long, beaten long"


def bias(queries: DataFrame, gallery: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], flips: int, pool: int, reach: float, top: int, block: int = BLOCK) -> DataFrame:
    """(q, availability, evidence, identity) of queries (item, vec, z) and a gallery (item, seen, unseen, z, shown); self left out.

    Each flip shows the gallery's rows with their own data (seen) where shown[flip] is true and with what is guessed without
    (unseen) elsewhere. Of the `pool` best rows of a flip, the share that is shown is held against the share among all rows: of rows whose z
    is not near the query's for availability, of near ones for evidence; both are means over flips, null where no flip has
    such a row. identity: fewer than `top` others score more with their data than the query's own row without. Near: |z -
    z of query| / (1 + z of query) < reach. A tile leaves its best rows and a few counts for each query and flip; equal scores go to the
    smaller item. A row without z is near to nothing.
    """

    def made(ours: pa.StructArray, theirs: pa.StructArray) -> Iterator[pa.RecordBatch]:
        items = numbers(theirs, "item")
        order = np.argsort(items, kind="stable")
        for at in range(0, len(order), TILE):
            yield from tile(ours, theirs.take(pa.array(order[at : at + TILE])))

    def tile(ours: pa.StructArray, theirs: pa.StructArray) -> Iterator[pa.RecordBatch]:
        qi, gi, qz, gz = numbers(ours, "item"), numbers(theirs, "item"), numbers(ours, "z").astype(float), numbers(theirs, "z").astype(float)
        shown = numbers(theirs, "shown").astype(bool)
        seen, unseen = (np.round(score(numbers(ours, "vec"), numbers(theirs, c)), PLACES) for c in ("seen", "unseen"))
        other = qi[:, None] != gi[None, :]
        near = (np.abs(gz[None, :] - qz[:, None]) / (1 + qz[:, None]) < reach) & other
        far = other & ~near
        beaten = ((seen > np.round(numbers(ours, "own"), PLACES)[:, None]) & other).sum(1)
        for f in range(flips):
            of = shown[:, f]
            mixed = np.where(other, np.where(of[None, :], seen, unseen), -np.inf)
            best = np.argsort(-mixed, axis=1, kind="stable")[:, :pool]
            r = np.repeat(np.arange(len(qi)), best.shape[1])
            c = best.ravel()
            r, c = r[other[r, c]], c[other[r, c]]
            n, empty = len(r), len(qi)
            columns = [(np.concatenate([qi[r], qi]), pa.int64()), (np.full(n + empty, f), pa.int32())]
            columns += [(values, kind) for values, kind in ((gi[c], pa.int64()), (mixed[r, c], pa.float64()), (of[c], pa.bool_()), (near[r, c], pa.bool_()))]
            counts = [near.sum(1), (near & of).sum(1), far.sum(1), (far & of).sum(1), beaten if f == 0 else np.zeros(empty, np.int64)]
            columns += [(np.concatenate([np.zeros(n, np.int64), x]), pa.int64()) for x in counts]
            # rows of counts have no item
            arrays = [pa.concat_arrays([pa.array(x, kind), pa.nulls(empty, kind)]) if len(x) == n and empty else pa.array(x, kind) for x, kind in columns]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])

    def one(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [score(a, b)]

    own = pair_scores(queries.select("item", F.col("vec").alias("a")).join(gallery.select("item", F.col("unseen").alias("b")), "item"), one)
    asked = queries.join(own.select("item", F.col("own")[0].alias("own")), "item")
    found = met(asked.select("item", "vec", "z", "own"), gallery.select("item", "seen", "unseen", "z", "shown"), made, SCHEMA, block)

    # a flip's counts and its tiles' best rows in one shuffle; rows of counts have no item and come behind all places
    place = F.row_number().over(Window.partitionBy("q", "flip").orderBy(F.desc_nulls_last("score"), "item"))
    placed = found.withColumn("picked", (place <= pool) & F.col("item").isNotNull())
    share = lambda near: F.avg(F.when(F.col("picked") & (F.col("near") == near), F.col("shown").cast("double")))
    part = lambda name: F.sum(f"{name}_shown") / F.when(F.sum(f"{name}_n") > 0, F.sum(f"{name}_n"))
    each = placed.groupBy("q", "flip").agg((share(False) - part("far")).alias("availability"), (share(True) - part("near")).alias("evidence"), F.sum("beaten").alias("beaten"))
    return each.groupBy("q").agg(F.avg("availability").alias("availability"), F.avg("evidence").alias("evidence"), (F.sum("beaten") < top).alias("identity"))
