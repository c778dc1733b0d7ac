"""N-gram Jaccard self-join with rare-first prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.components import joined
from starloom.llm.scratch import bitmap, bits_for, in_bitmap, row_key, written
from starloom.llm.spans import NOT_SPACE, Words, grams, mixed, slices

#: Words of a shingle. Two sets link when 4 * intersection >= 3 * union (0.75).
SHINGLE = 5
#: Shingles that a task counts at once, the count from which it reports one, and how many of the most frequent are told apart.
CHUNK, REPORTED, FREQUENT = 2 << 20, 3, 1_000_000
#: Classes in a short list, whose pairs are all candidates, so at most half as many pairs for each place as this.
SHORT = 32
#: Classes that a part of a list holds, about; a list of more is split.
PART = 2000
#: Rounds of leaders at most, and the share of open classes that a round must link for another one to follow. Both decide cost alone.
ROUNDS, GAIN = 6, 0.02
#: Pairs of whole sets that a task holds at once.
BATCH = 256
#: Columns of 64 bits in the parity bitmap of a class, and in the same bitmap folded to half.
PARITY, FOLDED = [f"p{i}" for i in range(32)], [f"f{i}" for i in range(16)]


def shingle_sets(words: Words, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; of fewer words than n, but not none, the whole sequence is one."""
    hashes = words.hashes()
    runs = grams(hashes, n)
    out = []
    for row in range(len(words)):
        low, high = words.bounds[row : row + 2]
        if high - low >= n:
            out.append(np.unique(runs[low : high - n + 1]))
        else:
            out.append(grams(hashes[low:high], high - low) if high > low else runs[:0])
    return out


def signature(held: np.ndarray) -> int:
    """One 64-bit value for a set: equal sets have equal ones."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(held).sum() + np.uint64(len(held))], np.uint64)).view(np.int64)[0])


def parity(held: np.ndarray) -> np.ndarray:
    """For each bit of the bitmap, whether an odd number of shingles falls on it.

    Where the bitmaps of two sets differ, at least one shingle is in one of them alone.
    """
    at = (held >> np.uint64(20)).astype(np.int64) % (64 * len(PARITY))
    return np.packbits((np.bincount(at, minlength=64 * len(PARITY)) & 1).astype(np.uint8)).view(np.int64)


_ROWS = pa.schema(
    [(c, pa.int64()) for c in ("id", "key", "n", "sig", *PARITY)] + [("counted", pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())])))]
)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to the size, signature and parity of each set, and the shingles that are frequent within the task.

    A shingle in more sets than there are chunks is reported by some chunk, so none that is frequent in the whole
    corpus goes unseen; of equal sets a chunk counts one.
    """
    counted: list[np.ndarray] = []
    seen: set[int] = set()
    held = 0

    def frequent() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(counted), return_counts=True) if counted else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        most = n >= REPORTED
        found = [{"token": t, "n": c} for t, c in zip(tokens[most].view(np.int64).tolist(), n[most].tolist(), strict=True)]
        rows = [found[i : i + 10_000] for i in range(0, len(found), 10_000)]
        empty = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([empty] * (len(_ROWS) - 1) + [pa.array(rows, _ROWS.field("counted").type)], schema=_ROWS)

    for batch in batches:
        sizes, sigs, bits = [], [], []
        for words in slices(batch.column("text"), NOT_SPACE, True):
            for x in shingle_sets(words):
                sizes.append(len(x))
                sigs.append(signature(x) if len(x) else None)
                bits.append(parity(x))
                if len(x) and sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    counted.append(x)
                    held += len(x)
            if held >= CHUNK:
                yield frequent()
                counted, seen, held = [], set(), 0
        nothing = pa.nulls(len(sizes), _ROWS.field("counted").type)
        columns = np.array(bits, np.int64).reshape(-1, len(PARITY)).T
        described = [pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), *[pa.array(c) for c in columns]]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *described, nothing], schema=_ROWS)
    yield frequent()


def prefixes(order: object, part_size: int = PART) -> Callable:
    """(text) to the prefix of each set in rare-first order: token, part of its list (-1: not split), class, set size, place from 1.

    `order` is a broadcast of the frequent shingles, sorted, and their counts. Order: the power of two in the shingle's
    count (0 where it isn't frequent), then the hash. Sets that link share a token of their prefixes of
    n - ceil(0.75 n) + 1. Of equal sets a task sends one.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("token", "part", "sig", "n", "pos")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = order.value
        ranks, split = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, np.maximum(1, counts // part_size)
        seen: set[int] = set()
        for batch in batches:
            for words in slices(batch.column("text"), NOT_SPACE, True):
                out: list[tuple[np.ndarray, ...]] = []
                for x in shingle_sets(words):
                    if not len(x) or (sig := signature(x)) in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(sig)
                    first = len(x) - (3 * len(x) + 3) // 4 + 1
                    rank, parts = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                        known = tokens[at] == x
                        rank[known], parts[known] = ranks[at[known]], split[at[known]]
                    chosen = np.argsort(rank, kind="stable")[:first]
                    parts = parts[chosen]
                    out.append((x[chosen].view(np.int64), np.where(parts > 1, np.int64(sig) % parts, -1), np.full(first, sig), np.full(first, len(x)), np.arange(1, first + 1)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def brief(held: np.ndarray) -> bytes:
    """The size of a set, then the places on which an odd number of its shingles falls, a bit each: two to four bits a shingle.

    Where those of two sets differ, at least one shingle is in one of them alone. There are enough places that sets with
    little in common differ on more of them than sets that link may.
    """
    bits = 1 << max(6, (2 * len(held) - 1).bit_length())
    places, n = np.unique((held >> np.uint64(20)) & np.uint64(bits - 1), return_counts=True)
    odd = np.zeros(bits, bool)
    odd[places[n % 2 == 1].astype(np.int64)] = True
    return np.uint32(len(held)).tobytes() + np.packbits(odd).tobytes()


def wanted_sets(held: object, bits: int, short: bool) -> Callable:
    """(key, text) to (key, sig, shingles) of the rows that may be wanted: 8 bytes a shingle in order, or `brief` ones; held is a broadcast."""
    schema = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(held.value, batch.column("key").to_numpy(zero_copy_only=False), bits)))
            keys, at = batch.column("key"), 0
            for words in slices(batch.column("text"), NOT_SPACE, True):
                sets = shingle_sets(words)
                sigs = [signature(x) if len(x) else None for x in sets]
                packed = [brief(x) if short else x.tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(sets)), pa.array(sigs, pa.int64()), pa.array(packed, pa.binary())], schema=schema)
                at += len(sets)

    return run


def may_overlap(a: np.ndarray, b: np.ndarray, needed: int, depth: int = 3) -> bool:
    """Suffix filter: split both sorted sets at the same value, again and again; no more can be shared than each pair of parts allows."""

    def most(a: np.ndarray, b: np.ndarray, depth: int) -> int:
        if not depth or min(len(a), len(b)) < 8:
            return min(len(a), len(b))
        cut = a[len(a) // 2]
        i, j = len(a) // 2, int(np.searchsorted(b, cut))
        return most(a[:i], b[:j], depth - 1) + most(a[i:], b[j:], depth - 1)

    return most(a, b, depth) >= needed


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, a_set, b_set) to the pairs that link: each is compared once, whole."""
    for batch in batches:
        kept = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("a_set", "b_set"))
            needed = -(-3 * (len(x) + len(y)) // 7)
            if may_overlap(x, y, needed):
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                if 4 * same >= 3 * (len(both) - same):
                    kept.append(i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, a_set, b_set), sets being `brief`, to the pairs that may link: those differ in at most (n + m) / 7 shingles."""
    for batch in batches:
        kept = []
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].as_buffer() for c in ("a_set", "b_set"))
            sizes = sum(int(np.frombuffer(s, np.uint32, 1)[0]) for s in (x, y))
            x, y = (np.frombuffer(s, np.uint8, offset=4) for s in (x, y))
            while len(x) != len(y):  # the longer one folded to half has the places of a set half as large
                longer, shorter = (x, y) if len(x) > len(y) else (y, x)
                x, y = np.bitwise_xor(*np.split(longer, 2)), shorter
            if 7 * int(np.bitwise_count(x ^ y).sum()) <= sizes:
                kept.append(i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def _may_link(n: Column, m: Column, pos: Column, o_pos: Column) -> Column:
    """Length and positional filters on two sets of n and m shingles that share the ones at places pos and o_pos.

    Of the overlap that a link needs, all lies at or after the first shared shingle, so in either set that one's place
    is at most n - needed + 1; pairs that link share at least that shingle.
    """
    spare = F.ceil(3 * (n + m) / 7) - 1
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (pos <= n - spare) & (o_pos <= m - spare)


def _fits(pairs: DataFrame) -> DataFrame:
    """`_may_link` on pairs (sig, n, pos, o_sig, o_n, o_pos)."""
    return pairs.where(_may_link(F.col("n"), F.col("o_n"), F.col("pos"), F.col("o_pos")))


def _near(pairs: DataFrame, ours: list[str], theirs: list[str], n: str, m: str) -> DataFrame:
    """Bitmap filter. Sets that link differ in at most (n + m) / 7 shingles, and their bitmaps in no more bits."""
    differ = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(ours, theirs, strict=True)), F.lit(0))
    return pairs.where(7 * differ <= F.col(n) + F.col(m))


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b, n, m), a < b, each pair once, of rows with sig, n, o_sig, o_n."""
    back = F.col("sig") > F.col("o_sig")
    either = lambda x, y, name: F.when(back, F.col(y)).otherwise(F.col(x)).alias(name)
    return rows.select(F.least("sig", "o_sig").alias("a"), F.greatest("sig", "o_sig").alias("b"), either("n", "o_n", "n"), either("o_n", "n", "m")).distinct()


def _fetched(pairs: DataFrame, classes: DataFrame, texts: DataFrame, short: bool) -> DataFrame:
    """(sig, shingles) of all classes in pairs, made again from the texts as they are read, so that no table of sets is kept."""
    needed = written(_sides(pairs).join(classes, "sig").select(F.col("sig").alias("w_sig"), F.col("key").alias("w_key"), "times"))
    count, most = needed.agg(F.count("*"), F.max("times")).first()
    bits = bits_for(count, 64)
    held = texts.sparkSession.sparkContext.broadcast(bitmap(needed, "w_key", bits))
    found = texts.mapInArrow(wanted_sets(held, bits, short), "key long, sig long, shingles binary")
    # dealt by sig alone, as the pairs are: a test of both keys at once would deal the sets twice
    found = found.join(needed, (F.col("sig") == F.col("w_sig")) & (F.col("key").bitwiseXOR(F.col("w_key")) == 0)).select("sig", "shingles")
    return found.dropDuplicates(["sig"]) if most > 1 else found  # rows repeated whole


def _sides(pairs: DataFrame) -> DataFrame:
    """(sig), each class of pairs (a, b) once."""
    return pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig"))).distinct()


def _compared(pairs: DataFrame, classes: DataFrame, texts: DataFrame, short: bool = False) -> DataFrame:
    """The links among pairs (a, b), written; or, by `brief` sets, the pairs that may be links."""
    sets = _fetched(pairs, classes, texts, short)
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("a_set")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("b_set")), "b")
    return written(both.select("a", "b", "a_set", "b_set").mapInArrow(close if short else links, "a long, b long"), BATCH)


def _starred(pairs: DataFrame) -> DataFrame:
    """Of each class the pair (a, b) with the least other one: in a group where all are candidates, a star."""
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) between different components (node, comp); a class without one is its own."""
    for c in "ab":
        of = comps.select(F.col("node").alias(f"{c}_node"), F.col("comp").alias(f"{c}_comp"))
        pairs = pairs.join(of, F.col(c) == F.col(f"{c}_node"), "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c)).drop(f"{c}_node")
    return pairs.where("a_comp <> b_comp").select("a", "b")


def _led(lists: DataFrame, seed: int) -> DataFrame:
    """Pairs of each part's leader with its members of other components, and of the leaders of a list's parts with the first of them.

    The first leaders are the members of most lists, which tend to be a group's middle; later ones are drawn anew for
    each list and round.
    """
    fields = [c for c in lists.columns if c not in ("token", "part", "parts", "places")]
    middle = -F.col("places") if seed == 0 else F.lit(0)
    member = F.struct(middle.alias("o"), F.xxhash64("sig", "token", F.lit(seed)).alias("h"), *fields)
    heads = written(lists.groupBy("token", "part", "parts").agg(F.min(member).alias("m")))
    named = [F.col(f"m.{c}").alias(f"o_{c}") for c in fields]
    pairs = lists.join(heads.select("token", "part", *named), ["token", "part"])
    several = heads.where("parts > 1")
    first = several.groupBy("token").agg(F.min("m").alias("m")).select("token", *named)
    across = several.select("token", *[F.col(f"m.{c}").alias(c) for c in fields]).join(first, "token")
    columns = fields + [f"o_{c}" for c in fields]
    return pairs.select(columns).unionAll(across.select(columns)).where("comp <> o_comp")


def _rest(lists: DataFrame, bits: DataFrame) -> DataFrame:
    """All pairs of a token's classes in different components that pass the filters.

    A list's largest component isn't paired with itself, so a group of near copies costs its members once for each class
    that stays beside it. A list of several parts is dealt by pairs of parts, so no task gets it whole. Comparing takes
    longer than reading, so rows are dealt to a fixed number of tasks, and bitmaps are compared here as folded ones, which
    differ in no more bits than whole ones.
    """
    spark, folds = lists.sparkSession, len(PARITY) // len(FOLDED)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def folded(i: int) -> Column:
        out = F.col(PARITY[i])
        for k in range(1, folds):
            out = out.bitwiseXOR(F.col(PARITY[i + k * len(FOLDED)]))
        return out

    sizes = lists.groupBy("token", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"))
    lists = lists.join(main, "token").withColumn("beside", F.col("comp") != F.col("main")).join(bits, "sig").withColumns({name: folded(i) for i, name in enumerate(FOLDED)})
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(F.least(p, "part").alias("low"), F.greatest(p, "part").alias("high")))
    fields = ["sig", "n", "pos", "part", "comp", "beside", *FOLDED]
    cells = lists.select("token", F.explode(cell).alias("cell"), *fields)
    other = cells.select("token", "cell", *[F.col(c).alias(f"o_{c}") for c in fields])
    whole = (F.col("part") != F.col("o_part")) | (F.col("cell.low") == F.col("cell.high"))
    once = ~F.col("o_beside") | (F.col("sig") < F.col("o_sig"))
    pairs = cells.where("beside").repartition(tasks, "token", "cell").join(other.repartition(tasks, "token", "cell"), ["token", "cell"])
    pairs = _fits(pairs.where((F.col("comp") != F.col("o_comp")) & whole & once))
    return _near(pairs, FOLDED, [f"o_{c}" for c in FOLDED], "n", "o_n")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, rounds: int = ROUNDS, part_size: int = PART) -> DataFrame:
    """One row for each row of df: doc_id, key (see `row_key`), n_shingles, component_id.

    Words are [^\\x20\\x09-\\x0D]+ after A-Z is lower-cased; a set holds the distinct 5-word shingles, or the whole
    sequence of fewer words; null and empty texts have empty sets and link with nothing. Sets link at Jaccard 0.75 or
    more. component_id is the smallest doc_id that links reach; a null doc_id counts as none. Rows repeated whole get a
    row each. Ids are whole numbers; other columns of df, whatever their names, aren't looked at. An empty df gives none.

    1. Equal sets are one class, so copies are compared once, as a class.
    2. Each class sends its rare-first prefix; classes that link share a prefix token, and a token's classes are its list.
    3. Of a list of at most `short` classes all pairs are candidates, in proportion to the lists' length.
    4. Longer lists are compared with a leader in rounds: links join components, and pairs within a component need no
       comparing. So a large group of near copies costs a few comparisons for each member, not all pairs. When rounds
       link no more, what is left between different components of one list is paired.
    5. Length, positional and bitmap filters, which can't lose a link, act as pairs are made; the rest are compared on
       whole sets: first one pair for each class, then those that are still between different components. Nothing is left out at any size. `short`, `rounds` and
       `part_size` (classes of a part of a longer list) decide cost alone.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    longs = ", ".join(f"{c} long" for c in _ROWS.names[:-1])
    described = written(rows.mapInArrow(describe, f"{longs}, counted array<struct<token: long, n: long>>"))
    docs = described.where("counted is null").drop("counted")
    top = (
        described.where("counted is not null")
        .select(F.explode("counted").alias("c"))
        .groupBy("c.token")
        .agg(F.sum("c.n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    tokens, counts = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    at = np.argsort(tokens)
    order = spark.sparkContext.broadcast((tokens[at], counts[at]))
    sent = df.select(F.col(text_col).alias("text")).mapInArrow(prefixes(order, part_size), ", ".join(f"{c} long" for c in ("token", "part", "sig", "n", "pos")))
    # one shuffle: classes of a token side by side, each once; short lists leave as pairs, longer ones as they are
    list_, sorted_ = "partition by token, part", "partition by token, part order by sig"
    shared = sent.selectExpr("*", f"min(sig) over ({list_}) as low", f"max(sig) over ({list_}) as high").where("part >= 0 or low < high").drop("low", "high")
    shared = shared.selectExpr("*", f"lag(sig) over ({sorted_}) as last").where("last is null or last <> sig").drop("last")
    shared = shared.selectExpr("*", f"count(*) over ({list_}) as size", f"collect_list(struct(sig as o_sig, n as o_n, pos as o_pos)) over ({sorted_} rows between {max(1, short - 1)} preceding and 1 preceding) as earlier")
    is_long = (F.col("part") >= 0) | (F.col("size") > short)
    likely = F.filter("earlier", lambda o: _may_link(F.col("n"), o["o_n"], F.col("pos"), o["o_pos"]))
    likely = F.transform(likely, lambda o: F.struct(o["o_sig"].alias("o_sig"), o["o_n"].alias("o_n")))
    shared = shared.select("token", "part", "sig", "n", "pos", is_long.alias("long"), F.when(~is_long, likely).alias("earlier"))
    lists = written(shared.where(F.col("long") | (F.size("earlier") > 0)))
    pairs = lists.where("not long").select("sig", "n", F.explode("earlier").alias("o")).select("sig", "n", "o.*")
    classes = docs.where("sig is not null").groupBy("sig", "key").agg(F.min("id").alias("least"), F.count("*").alias("times"))
    classes = written(classes.groupBy("sig").agg(F.min("least").alias("least"), F.min(F.struct("key", "times")).alias("k")).select("sig", "least", "k.*"))
    comps = _linked(_pairs(pairs), lists.where("long").select("token", "part", "sig", "n", "pos"), docs.select("sig", *PARITY), classes.drop("least"), rows.select("key", "text"), rounds)
    classes = classes.select("sig", "least").join(comps, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("comp", "sig").alias("comp"))
    classes = written(classes)
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = written(classes.join(least, "comp").select(F.col("sig").alias("c_sig"), "component_id"))
    return docs.select("id", "key", "n", "sig").join(classes, F.col("sig") == F.col("c_sig"), "left").select(
        F.col("id").alias("doc_id"), "key", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _linked(pairs: DataFrame, lists: DataFrame, bits: DataFrame, keys: DataFrame, texts: DataFrame, rounds: int) -> DataFrame:
    """(node, comp) of the classes that link, from the pairs of short lists and the longer lists."""
    pairs = written(pairs)
    # of most classes no bitmap is looked at: the others' are kept apart once
    seen = written(_sides(pairs).unionAll(lists.select("sig")).distinct())
    bits = written(bits.join(seen, "sig", "left_semi").dropDuplicates(["sig"]))
    marked = lambda side: bits.select(F.col("sig").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in PARITY])

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(marked("a"), "a").join(marked("b"), "b")
        return _near(both, [f"a_{c}" for c in PARITY], [f"b_{c}" for c in PARITY], "n", "m")

    many, parts = lists.groupBy("sig").agg(F.count("*").alias("places")), lists.groupBy("token").agg((F.max("part") + 1).alias("parts"))
    parts = parts.withColumn("parts", F.greatest(F.lit(1), "parts"))
    now = lists.join(many, "sig").join(parts, "token").withColumn("part", F.greatest(F.lit(0), "part"))
    now = written(now.withColumn("comp", F.col("sig")))
    comps = None
    for seed in range(rounds + 2):
        last = seed == rounds + 1
        if comps is not None:
            of = now.drop("comp").join(comps, F.col("sig") == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("comp", "sig"))
            open_ = of.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
            now = written(of.join(open_, "token", "left_semi"))
            open_ = now.select("sig").distinct().count()
            if not open_:
                return comps
            last = last or gained < GAIN * open_
        made = _pairs(_rest(now, bits) if last else _fits(_led(now, seed)))
        made = near(made if comps is not None else made.unionAll(pairs).distinct())
        made = written(made.select("a", "b"))
        gained = 0
        for stars in (True, False):
            # one pair for each class joins most of a group, and pairs within a component need no comparing
            tried = found = written(_starred(made)) if stars else made
            for short in (True, False):  # many are long sets with one passage in common
                if not found.isEmpty():
                    found = _compared(found, keys, texts, short)
            new = found.count()
            gained += new
            comps = joined(comps, found) if new or comps is None else comps
            if stars and not made.isEmpty():
                made = written(_apart(made.join(tried, ["a", "b"], "left_anti"), comps))
        if last:
            return comps
    raise AssertionError("the last round returns")
