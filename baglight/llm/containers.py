"""Filling fixed-capacity containers with items.

Documents are packed by their length in tokens, whole unless longer than the capacity. What decides
a packing is only how many documents there are of each length, at most as many numbers as the
capacity, whatever the corpus. So lengths are counted in Spark, the packing is sought on the counts,
and its patterns (so many documents of these lengths, so many times) are dealt to the documents by
their rank within their length. Nothing grows with the corpus but the two passes over its rows.

The search is bin completion by branch and bound. The incumbent is the best-fit decreasing packing.
For a target number of containers, from the lower bound up to one less than the incumbent, containers
are filled one by one around the largest document left: fillings are enumerated from large to small,
dominated ones are dropped (one whose document, or pair of documents, an unused one could replace
within the slack), each is repeated as often as the counts allow, and a branch ends when the waste so
far exceeds what the target leaves. Branches are tried up to a bound on nodes, a parameter.

Documents longer than the capacity are cut into full containers and one rest, which is packed like
any document. Defined cases: null and empty texts have no tokens, take no room and are spread over
the containers by their id (container 1 where there is none); repeated ids count as documents of their
own; a capacity below 1 is an error; an empty corpus gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baglight.functions.stage import stage
from baglight.operators.rows import running_sum

Pattern = tuple[tuple[tuple[int, int], ...], int]
FILLINGS, STEPS, NODES, WIDER = 6, 400, 50_000, 8


class _Left:
    """Lengths still to be packed with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, filling: tuple[tuple[int, int], ...], times: int) -> None:
        for s, n in filling:
            self.count[s] -= n * times
            if not self.count[s]:
                del self.count[s]
                del self.sizes[bisect_right(self.sizes, s) - 1]

    def give(self, filling: tuple[tuple[int, int], ...], times: int) -> None:
        for s, n in filling:
            if s in self.count:
                self.count[s] += n * times
            else:
                self.count[s] = n * times
                insort(self.sizes, s)


def fillings(left: _Left, room: int, wide: int = 1) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated ways to fill room, as (waste, filling), the least waste first."""
    found: dict[tuple[tuple[int, int], ...], int] = {}
    steps = 0
    sizes, count = left.sizes, left.count

    def close(chosen: list[tuple[int, int]], rest: int) -> None:
        found.setdefault(tuple(chosen), rest)

    def search(at: int, chosen: list[tuple[int, int]], rest: int, breadth: int) -> bool:
        nonlocal steps
        steps += 1
        at = min(at, bisect_right(sizes, rest))
        if at == 0:
            close(chosen, rest)
            return rest == 0
        exact = at and sizes[at - 1] == rest
        if exact:
            close([*chosen, (rest, 1)], 0)
            return True
        # Two documents that fill the rest.
        for i in range(at - 1, max(-1, at - 1 - 24), -1):
            other = rest - sizes[i]
            if other > sizes[i]:
                break
            if count.get(other, 0) > (other == sizes[i]):
                close([*chosen, (sizes[i], 2)] if other == sizes[i] else [*chosen, (sizes[i], 1), (other, 1)], 0)
                return True
        done = False
        for i in range(at - 1, max(-1, at - 1 - breadth), -1):
            s = sizes[i]
            n = min(count[s], rest // s)
            for q in (n, n - 1) if n > 1 else (n,):
                done |= search(i, [*chosen, (s, q)], rest - q * s, max(1, breadth - 1))
                if steps > wide * STEPS or len(found) >= 4 * wide * FILLINGS or done and len(found) >= wide * FILLINGS:
                    return done
        return done

    search(len(sizes), [], room, 3 * wide)
    best = sorted(found.items(), key=lambda f: (f[1], [-s for s, _ in f[0]]))
    kept = [(w, f) for f, w in best if not _dominated(f, w, left)]
    return kept[: wide * FILLINGS]


def _dominated(filling: tuple[tuple[int, int], ...], waste: int, left: _Left) -> bool:
    """Could an unused document replace one of these, or two of them, within the slack?"""
    if not waste:
        return False
    used = dict(filling)
    sums = {s for s, _ in filling} | {a + b for a, x in filling for b, _ in filling if a != b or x > 1}
    for x in sums:
        for i in range(bisect_right(left.sizes, x), len(left.sizes)):
            y = left.sizes[i]
            if y > x + waste:
                break
            if left.count[y] > used.get(y, 0):
                return True
    return False


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: the incumbent. Equal documents go by the container-full."""
    rooms: dict[int, list[list]] = {}
    order: list[int] = []
    out: list[list] = []
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_right(order, size - 1)
            if i < len(order):
                room = order[i]
                entry = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    del order[i]
                content, times = entry
                q = min(room // size, n)
                use = min(times, n // q)
                if use < times:
                    _room(rooms, order, room, [content, times - use])
                new = [*content, (size, q)]
                n -= q * use
                room -= q * size
                times = use
            else:
                q = min(capacity // size, n)
                times = n // q
                n -= q * times
                room, new = capacity - q * size, [(size, q)]
            if room:
                _room(rooms, order, room, [new, times])
            else:
                out.append([new, times])
    out += [e for es in rooms.values() for e in es]
    return [(tuple(c), t) for c, t in out]


def _room(rooms: dict, order: list[int], room: int, entry: list) -> None:
    if room not in rooms:
        rooms[room] = []
        insort(order, room)
    rooms[room].append(entry)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's bound over all thresholds up to half the capacity."""
    total = np.zeros(capacity + 2, np.int64)
    number = np.zeros(capacity + 2, np.int64)
    for s, n in counts.items():
        number[s] += n
        total[s] += n * s
    n_upto, v_upto = np.cumsum(number), np.cumsum(total)
    best = -(-int(v_upto[-1]) // capacity)
    half = capacity // 2
    for k in range(half + 1):
        big = n_upto[-1] - n_upto[capacity - k]  # longer than capacity - k
        mid = n_upto[capacity - k] - n_upto[half]
        volume = v_upto[capacity - k] - v_upto[half]
        small = v_upto[half] - (v_upto[k - 1] if k else 0)
        best = max(best, int(big + mid + max(0, -(-int(small - (mid * capacity - volume)) // capacity))))
    return best


def pack(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns ((length, documents), ...), repetitions) that hold every document of counts once."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return []
    incumbent = best_fit(counts, capacity)
    size = sum(t for _, t in incumbent)
    bound = lower_bound(counts, capacity)
    volume = sum(s * n for s, n in counts.items())
    best, tried, target = incumbent, set(), bound
    while target < size and nodes > 0:
        found, nodes = _complete(counts, capacity, target * capacity - volume, nodes)
        tried.add(target)
        if found:
            best, size = found, sum(t for _, t in found)
            break
        target += max(1, (size - target) // 4)
    # The targets that were passed over, then all below the best with more fillings.
    for wide in (1, WIDER):
        for target in range(bound, size):
            if nodes <= 0:
                return best
            if wide == 1 and target in tried:
                continue
            found, nodes = _complete(counts, capacity, target * capacity - volume, nodes, wide)
            if found:
                best, size = found, sum(t for _, t in found)
                break
    return best


def _complete(counts: dict[int, int], capacity: int, slack: int, nodes: int, wide: int = 1) -> tuple[list[Pattern] | None, int]:
    """Depth-first bin completion with at most slack wasted in all; what is left of nodes."""
    left = _Left(counts)
    path: list[tuple[tuple[tuple[int, int], ...], int, int, Iterator]] = []

    def choices() -> Iterator:
        largest = left.sizes[-1]
        left.take(((largest, 1),), 1)
        ways = fillings(left, capacity - largest, wide)
        left.give(((largest, 1),), 1)
        for waste, filling in ways:
            whole: dict[int, int] = {largest: 1}
            for s, n in filling:
                whole[s] = whole.get(s, 0) + n
            yield waste, tuple(sorted(whole.items(), reverse=True))

    todo = choices()
    while True:
        nodes -= 1
        step = next(todo, None) if nodes > 0 else None
        if nodes <= 0:
            return None, 0
        if step is None or step[0] > slack:
            if not path:
                return None, nodes
            filling, times, waste, todo = path.pop()
            left.give(filling, times)
            slack += waste * times
            continue
        waste, filling = step
        times = min(left.count[s] // n for s, n in filling)
        if waste:
            times = min(times, slack // waste)
        left.take(filling, times)
        slack -= waste * times
        path.append((filling, times, waste, todo))
        if not left.sizes:
            return [(f, t) for f, t, _, _ in path], nodes
        todo = choices()


def pack_documents(sizes: DataFrame, specs: DataFrame, nodes: int = NODES) -> DataFrame:
    """spec_id, doc_id, piece, tokens, container of sizes (doc_id, tokenizer, tokens) for specs (spec_id, tokenizer, capacity).

    piece counts from 1; containers count from 1 within a spec.
    """
    spark = sizes.sparkSession
    spec = {r.spec_id: (r.tokenizer, r.capacity) for r in specs.select("spec_id", "tokenizer", "capacity").distinct().collect()}  # a row a container kind
    if any(c < 1 for _, c in spec.values()):
        raise ValueError("a container holds at least one token")
    table = spark.createDataFrame([(i, t, c) for i, (t, c) in spec.items()], "spec_id int, tokenizer string, capacity long")
    docs = stage(sizes, "sizes").join(F.broadcast(table), "tokenizer").select("spec_id", "capacity", "doc_id", F.coalesce("tokens", F.lit(0)).alias("n"))
    full = (F.col("n") / F.col("capacity")).cast("long")
    rest = F.col("n") - full * F.col("capacity")
    pieces = F.concat(F.array_repeat(F.col("capacity"), full.cast("int")), F.when((rest > 0) | (F.col("n") == 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    items = docs.select("spec_id", "doc_id", F.posexplode(pieces).alias("at", "tokens")).select("spec_id", "doc_id", (F.col("at") + 1).alias("piece"), "tokens")
    ranked = stage(running_sum(items, [F.col("spec_id"), F.col("tokens"), F.col("doc_id"), F.col("piece")], F.lit(1).cast("long"), "upto"), "ranked")
    # At most capacity + 1 lengths a spec.
    histogram = sorted((r.spec_id, r.tokens, r.n) for r in ranked.groupBy("spec_id", "tokens").agg(F.count("*").alias("n")).collect())
    before, first = 0, {}
    counts: dict[int, dict[int, int]] = {i: {} for i in spec}
    for i, s, n in histogram:
        first[i, s] = before
        before += n
        if s:
            counts[i][s] = n
    starts, bases, copies, totals = [], [], [], {}
    for i, (_, capacity) in sorted(spec.items()):
        base, used = 0, dict.fromkeys(counts[i], 0)
        for filling, times in pack(counts[i], capacity, nodes):
            for s, q in filling:
                starts.append(first[i, s] + used[s])
                bases.append(base)
                copies.append(q)
                used[s] += q * times
            base += times
        totals[i] = max(base, 1)
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    plan = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (starts, bases, copies)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, base, copy = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            tokens, rank = np.asarray(b.column("tokens")), np.asarray(b.column("upto")) - 1
            at = np.maximum(np.searchsorted(start, rank, side="right") - 1, 0)
            if len(start):
                container = base[at] + (rank - start[at]) // copy[at] + 1
            else:
                container = np.ones(len(rank), np.int64)
            many = np.array([totals[i] for i in b.column("spec_id").to_pylist()], np.int64)
            container = np.where(tokens == 0, rank % many + 1, container)
            yield pa.record_batch([b.column("spec_id"), b.column("doc_id"), b.column("piece"), b.column("tokens"), pa.array(container)], names=["spec_id", "doc_id", "piece", "tokens", "container"])

    return ranked.mapInArrow(place, "spec_id int, doc_id long, piece int, tokens long, container long")


def packing_report(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, capacity, containers, least (by volume), fullest, tokens of a packing."""
    per = placed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("held"))
    per = per.groupBy("spec_id").agg(F.count("*").alias("containers"), F.max("held").alias("fullest"), F.sum("held").alias("tokens"))
    return per.join(specs.select("spec_id", "capacity").distinct(), "spec_id").select("spec_id", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "fullest", "tokens")
