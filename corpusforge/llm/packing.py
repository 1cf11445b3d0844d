"""Mixture-controlled packing by deficit round robin (operator 1).

Every document's ids (its text's ids, then the end id) are laid into sequences of `window` ids. Sources are queues.
A window has `window / run` slots of `run` ids, and a queue is due its target share of them: the whole slots in every window, and
one more in those windows in which the fractions left over add up to one. So a queue's deficit grows until a run
is due; deficits are carried on from window to window and from partition to partition. Every window is within one run of each
source's target, all windows so far within a few runs (3.6 at most over 60 random mixtures), a period exactly, and pieces don't shrink as sources grow: documents are cut where a run ends
(runs of one queue that meet in a window are one). A queue that can't give its slots any longer leaves; the others
share them by their targets. What is left of such queues (less than a window's part each) is the tail, after all
other windows; only its last window is padded.

How it runs on Spark: texts are tokenised once and kept on shared storage. Only sums of ids by queue reach the
driver: from the sums follow the phases between which queues leave, and within a phase the slots that a queue
has filled before any window are a closed form (STEPS windows are a period). So a document's place follows from the ids
before it in its queue: queues are dealt by hash into buckets of about `bucket_ids` ids, running sums of the
buckets (one row each) give where each begins, and one task lays a bucket without waiting for others. A hot source
has many buckets, as rows are dealt by their number; sequences are put together by no one, their pieces fit.

Nulls: a null text counts as empty and gives the end id alone; a null source is a queue of its own; a
repeated doc_id is packed once a row. Equal rows are packed each. An empty table gives no rows. A very long text
is held whole by one task, at about ten bytes an id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .durable import saved
from .tokens import binary, default_path, tokenizer, with_end


#: Windows of a period: shares are rounded to one slot in so many windows.
STEPS = 4096
#: Queues that the sources beyond the largest share, dealt by hash.
REST = 64
#: The order in which windows of a period get the slots of fractions; odd, near the golden ratio of STEPS.
STRIDE = 2531


@dataclass
class Quantum:
    """What a queue fills in each window of a phase, numbered from 0: `base` slots, and one more in `more` of STEPS windows.

    before, low: the sums of `base` and `more` of the queues before it; at: its slots filled before the phase.
    """

    before: int
    base: int
    low: int
    more: int
    at: int

    def earlier(self, k: np.ndarray) -> np.ndarray:
        """Slots of fractions that the queues before it fill in windows k."""
        return -(-(self.low - k * STRIDE % STEPS) // STEPS)

    def chosen(self, k: np.ndarray) -> np.ndarray:
        """Whether it fills one more slot in windows k."""
        return -(-(self.low + self.more - k * STRIDE % STEPS) // STEPS) - self.earlier(k)

    def given(self, k: np.ndarray) -> np.ndarray:
        """Its slots in the windows before each of k."""
        if not hasattr(self, "sums"):
            self.sums = np.concatenate([[0], np.cumsum(self.chosen(np.arange(STEPS)))])
        return k * self.base + k // STEPS * self.more + self.sums[k % STEPS]

    def lasting(self, slots: int) -> int:
        """How many windows `slots` slots last."""
        most = slots * STEPS // (self.base * STEPS + self.more) + STEPS
        low, high = 0, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if int(self.given(np.array([middle]))[0]) <= slots else (low, middle - 1)
        return low


@dataclass
class Phase:
    """`windows` windows from `first` on, in which the same queues give their quanta."""

    first: int
    windows: int
    queues: dict[int, Quantum]


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, source, n, width, ids) for every row: ids little-endian, `width` bytes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for part in T.slices(batches, "text"):
            ids, at = with_end(*words.encode([t or "" for t in part.column("text").to_pylist()]), end_id)
            width = pa.array(np.full(part.num_rows, ids.dtype.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(np.diff(at)), width, binary(ids, at)], ["doc_id", "source", "n", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, source string, n long, width int, ids binary")


def schedule(totals: list[int], shares: list[float], window: int, run: int = 1) -> tuple[list[Phase], dict[int, int], int]:
    """Phases of the packing of queues of `totals` ids; each queue's place in the tail that follows; the tail's first window.

    A phase ends when a queue can't fill its slots any longer: what it still has goes to the tail, and the others
    share its slots. Queues of share 0 wait until no other is left. Only whole windows are in phases.
    """
    if window % run:
        raise ValueError(f"runs of {run} ids don't fill windows of {window}")
    slots, whole_runs = window // run, [n // run for n in totals]
    left, live, phases, tail, first, tail_ids = list(whole_runs), [s for s, n in enumerate(totals) if n > 0], [], {}, 0, 0
    while live:
        some = [s for s in live if shares[s] > 0] or live
        weigh = shares if shares[some[0]] > 0 else [max(n, 1) for n in left]
        whole = sum(weigh[s] for s in some)
        exact = [weigh[s] / whole * slots * STEPS for s in some]
        units = [int(x) for x in exact]
        for k in sorted(range(len(some)), key=lambda k: units[k] - exact[k])[: slots * STEPS - sum(units)]:
            units[k] += 1
        queues, before, low = {}, 0, 0
        for s, u in zip(some, units, strict=True):
            queues[s] = Quantum(before, u // STEPS, low, u % STEPS, whole_runs[s] - left[s])
            before, low = before + u // STEPS, low + u % STEPS
        lasts = {s: q.lasting(left[s]) for s, q in queues.items() if q.base or q.more}
        windows = min(lasts.values())
        if windows:
            phases.append(Phase(first, windows, queues))
            first += windows
            for s, q in queues.items():
                left[s] -= int(q.given(np.array([windows]))[0])
        for s in [s for s in live if not left[s] or lasts.get(s) == windows]:
            tail[s] = tail_ids
            tail_ids += totals[s] - (whole_runs[s] - left[s]) * run
            live.remove(s)
    return phases, tail, first


def laid(plan: tuple[list[Phase], dict[int, int], int], queue: int, low: int, high: int, window: int, run: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a queue's ids low .. high - 1 lie: where each stretch in one window begins, its window, and its offset there."""
    phases, tail, tail_first = plan
    begins, windows, offsets = [], [], []
    end, low_slot, high_slot = 0, low // run, -(-high // run)
    for p in phases:
        q = p.queues.get(queue)
        if q is None:
            continue
        end = q.at + int(q.given(np.array([p.windows]))[0])
        if end <= low_slot or q.at >= high_slot:
            continue
        period = STEPS * q.base + q.more  # the windows that can matter, by whole periods
        k = np.arange(max(0, (low_slot - q.at) // period * STEPS), min(p.windows, ((high_slot - q.at) // period + 1) * STEPS))
        begin, size = q.at + q.given(k), q.base + q.chosen(k)
        here = (size > 0) & (begin < high_slot) & (begin + size > low_slot)
        begins.append(begin[here] * run)
        windows.append(p.first + k[here])
        offsets.append((q.before + q.earlier(k[here])) * run)
    end *= run
    if high > end:  # the tail: one queue's ids after the other's
        place = np.unique(np.concatenate([[tail[queue]], np.arange((tail[queue] // window + 1) * window, tail[queue] + high - end, window)]))
        begins.append(end + place - tail[queue])
        windows.append(tail_first + place // window)
        offsets.append(place % window)
    return tuple(np.concatenate(x).astype(np.int64) for x in (begins, windows, offsets))


def pack_bucket(plan, window: int, run: int, with_ids: bool):
    """The packer of one bucket of a queue: (documents, its first id's number in the queue) to pieces."""

    def work(docs: pa.Table, base: pa.Table) -> pa.Table:
        docs = docs.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        low, n = base.column("base")[0].as_py(), docs.column("n").to_numpy()
        at = np.concatenate([[0], np.cumsum(n)])
        ids = np.concatenate([np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(docs.column("ids").to_pylist(), docs.column("width").to_pylist(), strict=True)])
        begin, seq, offset = laid(plan.value, docs.column("queue")[0].as_py(), low, low + int(at[-1]), window, run)
        cuts = np.unique(np.concatenate([np.maximum(begin - low, 0), at[:-1]]))
        stretch = np.searchsorted(begin - low, cuts, "right") - 1
        doc = np.searchsorted(at, cuts, "right") - 1
        ends = np.append(cuts[1:], at[-1])
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        columns = {"start": cuts - at[doc], "length": ends - cuts, "ids_crc32": crc, "doc_tokens": n[doc], "sequence_id": seq[stretch], "offset": offset[stretch] + cuts - (begin[stretch] - low)}
        held = pa.array([raw[4 * a : 4 * b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)] if with_ids else [None] * len(cuts), pa.binary())
        own = [docs.column(c).take(pa.array(doc)).combine_chunks() for c in ("doc_id", "source")]
        return pa.table([*own, *(pa.array(x, pa.int64()) for x in columns.values()), held], ["doc_id", "source", *columns, "ids"])

    return work


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, path: str | None = None, weights: dict[str, float] | None = None, run: int = 512, bucket_ids: int = 2_000_000, max_queues: int = 1000, with_ids: bool = False) -> DataFrame:
    """One row a piece of a document of `docs` (doc_id, text, source).

    weights: target proportions by source (scaled to sum 1; sources not named get 0 and are packed when
    nothing else is left); None: each source's own share of all ids. run: ids that a queue lays at once; it divides the window,
    and a smaller one follows the mixture closer with shorter pieces. start: the document's ids before the
    piece; ids_crc32: of the piece's ids as little-endian uint32; doc_tokens: the document's ids with the
    end id; offset: the piece's place in its sequence, without gaps. with_ids adds the ids themselves.
    max_queues: the largest so many sources, and those named, are queues of their own. Sources beyond them, each with less than
    one in max_queues of the ids, are dealt by hash to REST queues and mixed in these by chance; all their ids are packed.
    """
    tokens = saved(token_rows(docs, path or default_path(), end_id))
    sums = saved(tokens.groupBy("source").agg(F.sum("n").alias("ids")))
    named = [(s, float(w)) for s, w in (weights or {}).items()]
    rows = sums.orderBy(F.desc("ids"), "source").limit(max_queues).collect() + (sums.where(F.col("source").isin([s for s, _ in named])).collect() if named else [])
    found = sorted({r.source: r.ids for r in rows}.items(), key=lambda x: (x[0] is None, x[0] or ""))
    spark = tokens.sparkSession
    table = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(found)], "of string, own int")
    shared = F.pmod(F.xxhash64("source"), F.lit(REST)).cast("int") + len(found)
    queued = lambda df: df.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("queue", F.coalesce("own", shared)).drop("of", "own")
    rest = dict(queued(sums).where(F.col("queue") >= len(found)).groupBy("queue").agg(F.sum("ids")).collect())
    totals = [n for _, n in found] + [rest.get(len(found) + k, 0) for k in range(REST)]
    given = dict(named)
    shares = [given.get(s, 0.0) for s, _ in found] + [0.0] * REST if weights else [float(n) for n in totals]
    plan = spark.sparkContext.broadcast(schedule(totals, shares, window, run))
    buckets = spark.createDataFrame([(k, max(1, -(-n // bucket_ids))) for k, n in enumerate(totals)], "queue int, buckets long")
    tokens = queued(tokens.withColumn("row", F.monotonically_increasing_id())).join(F.broadcast(buckets), "queue")
    tokens = tokens.withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = tokens.groupBy("queue", "bucket").agg(F.sum("n").alias("n")).select("queue", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).toDF("of_queue", "of_bucket", "base")
    schema = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    pieces = tokens.groupBy("queue", "bucket").cogroup(bases.groupBy("of_queue", "of_bucket")).applyInArrow(pack_bucket(plan, window, run, with_ids), schema)
    return pieces if with_ids else pieces.drop("ids")
