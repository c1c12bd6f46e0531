"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and
with itself.

``Acceptor`` is a minimal acyclic automaton that numbers its words. Its composition
with a transducer of one inserted, deleted or replaced code point and the acceptor
again has states (p, 0, p) before the edit and (p, 1, q) after it; ``near_pairs``
enumerates the accepted pairs, and states after the edit are explored once a pair.

The whole vocabulary is in no one place. ``initial_states`` deals it by states of the
composed machine. A state (p, 0, p) is a prefix; the words under it are a partition.
Where they are more than ``BOUND``, the state is replaced by its successors: the
states one code point on, and the states in which that code point took the edit,
where words agree in all that follows. The latter have 8,191 words at most (the
alphabet has 90 letters), so every partition is bounded, however common a prefix is.

Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z
lower-cased. Null and empty texts have none; a null id is written as the empty string
in ``drop_every``'s hash. Nothing depends on the order of rows, and repeated rows count
as often as they are there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import Workspace

BOUND = 8192
SLICE = 1 << 20
FLUSH = 200_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


class Acceptor:
    """The minimal acceptor of sorted, distinct words. ``arcs[p]`` maps a code point to
    (state, words of p before those of that arc); word k is the k-th in order."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # states of the last word, not yet shared
        letters: list[str] = []

        def share(depth: int) -> None:
            while len(letters) > depth:
                state = self._state(known, *path.pop())
                path[-1][1].append((letters.pop(), state))

        for word in words:
            same = 0
            for a, b in zip(letters, word):
                if a != b:
                    break
                same += 1
            share(same)
            for c in word[same:]:
                letters.append(c)
                path.append([False, []])
            path[-1][0] = True
        share(0)
        self.root = self._state(known, *path[0])

    def _state(self, known: dict[tuple, int], final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in known:
            known[key] = len(self.arcs)
            total, placed = int(final), {}
            for c, state in arcs:
                placed[c] = (state, total)
                total += self.count[state]
            self.arcs.append(placed)
            self.final.append(final)
            self.count.append(total)
        return known[key]

    def _common(self, p: int, q: int, memo: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """Numbers, under p and under q, of the words that both accept."""
        if p == q:
            return [(i, i) for i in range(self.count[p])]
        todo = [(p, q)]
        while todo:  # no recursion: words may be long
            a, b = todo[-1]
            if (a, b) in memo:
                todo.pop()
                continue
            left, right = self.arcs[a], self.arcs[b]
            shared = [c for c in left if c in right]
            missing = [(left[c][0], right[c][0]) for c in shared if left[c][0] != right[c][0] and (left[c][0], right[c][0]) not in memo]
            if missing:
                todo.extend(missing)
                continue
            out = [(0, 0)] if self.final[a] and self.final[b] else []
            for c in shared:
                (x, at_x), (y, at_y) = left[c], right[c]
                inner = [(i, i) for i in range(self.count[x])] if x == y else memo[x, y]
                out += [(at_x + i, at_y + j) for i, j in inner]
            memo[a, b] = out
            todo.pop()
        return memo[p, q]

    def near_pairs(self) -> set[tuple[int, int]]:
        """Pairs of numbers of words with exactly one edit between them, each once."""
        memo: dict[tuple[int, int], list[tuple[int, int]]] = {}
        edits: dict[int, list[tuple[int, int]]] = {}
        found: set[tuple[int, int]] = set()
        paths = [(self.root, 0)]
        while paths:
            p, base = paths.pop()
            if p not in edits:
                arcs = list(self.arcs[p].values())
                here = []
                for k, (x, at_x) in enumerate(arcs):
                    here += [(at_x + i, j) for i, j in self._common(x, p, memo)]  # inserted
                    for y, at_y in arcs[:k]:
                        here += [(at_x + i, at_y + j) for i, j in self._common(x, y, memo)]  # replaced
                edits[p] = here
            found.update((base + i, base + j) if i < j else (base + j, base + i) for i, j in edits[p])
            paths += [(q, base + at) for q, at in self.arcs[p].values()]
        return found


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, drop_every: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least so many code points and occurrences. ``drop_every``:
    a run whose hash with the document's id it divides loses one code point."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen]), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                flat = (body or "").encode("latin-1", "replace").translate(_LETTERS)
                start = zlib.crc32(f"{name or ''}:".encode())
                at = 0
                while at < len(flat):
                    end = flat.find(b" ", at + SLICE)
                    end = len(flat) if end < 0 else end
                    own = Counter(w for w in flat[at:end].split() if len(w) >= least_length)
                    at = end
                    if drop_every:
                        for w in list(own):
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                            if h % drop_every == 0:
                                k = h % len(w)
                                n, cut = own.pop(w), w[:k] + w[k + 1 :]
                                if len(cut) >= least_length:
                                    seen[cut] += n
                    seen.update(own)
                    if len(seen) > FLUSH:
                        yield flush()
        if seen:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tally, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def initial_states(own: Workspace, words: DataFrame, bound: int = BOUND) -> DataFrame:
    """(state, word, n): the words dealt to states of the composed machine, so that
    every pair one edit apart meets in one at least."""
    parts, rest, depth = [], words, 0
    while True:
        prefix = F.substring("word", 1, depth)
        big = own.table(rest.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > bound).select("prefix"), "big")
        name = lambda kind, *more: F.concat_ws(" ", F.lit(f"{depth}{kind}"), prefix, *more).alias("state")  # noqa: B023, E731
        keyed = rest.withColumn("prefix", prefix)
        parts.append(keyed.join(big, "prefix", "left_anti").select(name("open"), "word", "n"))
        if big.isEmpty():
            break
        rest = own.table(keyed.join(big, "prefix", "left_semi").select("word", "n"), "rest")
        tails = [name("spent", F.expr(f"substr(word, {depth + k})")) for k in (2, 3)]  # as the shorter, as the longer word
        parts.append(rest.select(F.explode(F.array(*tails)).alias("state"), "word", "n"))
        depth += 1
        rest = rest.where(F.length("word") >= depth)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_words(own: Workspace, words: DataFrame, bound: int = BOUND) -> DataFrame:
    """(word, n, near, near_n): both directions; a pair may come more than once."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, int]]:
        state, held = None, {}
        for batch in batches:
            for key, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if key != state:
                    if len(held) > 1:
                        yield held
                    state, held = key, {}
                held[word] = n
        if len(held) > 1:
            yield held

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: tuple[list, ...] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["word", "n", "near", "near_n"])
            for c in columns:
                c.clear()
            return out

        for held in groups(batches):
            names = sorted(held)
            low, high = names[0], names[-1]  # first and last share the least
            cut = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
            for i, j in Acceptor([w[cut:] for w in names]).near_pairs():
                a, b = names[i], names[j]
                for c, value in zip(columns, ((a, b), (held[a], held[b]), (b, a), (held[b], held[a]))):
                    c.extend(value)
            if len(columns[0]) > 10_000:
                yield flush()
        if columns[0]:
            yield flush()

    dealt = initial_states(own, words, bound).repartition("state").sortWithinPartitions("state")
    return dealt.mapInArrow(compose, "word string, n bigint, near string, near_n bigint")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, drop_every: int | None = None, bound: int = BOUND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root): of each word its near words' number, the
    most frequent of them (ties: the first in code-point order) if it is ``ratio`` times
    as frequent, and the last word that forms lead to. Along forms the count grows at
    least ``ratio`` times, so roots need few rounds of pointer jumping."""
    if ratio < 2:
        raise ValueError("forms of a ratio below 2 could lead in circles")
    own = Workspace(docs.sparkSession, "spelling")
    words = own.table(count_words(docs, least_length, least_count, drop_every, doc_id, text), "words")
    near = F.collect_set(F.struct((-F.col("near_n")).alias("less"), "near"))  # bounded: 90 letters at each place
    best = near_words(own, words, bound).groupBy("word").agg(near.alias("s")).select("word", F.size("s").cast("long").alias("n_near"), F.array_min("s").alias("b"))
    joined = words.join(best, "word", "left").withColumn("strong", -F.col("b.less") >= ratio * F.col("n"))
    forms = own.table(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("strong"), F.col("b.near")).alias("form"), F.when(F.col("strong"), -F.col("b.less")).alias("form_n")), "forms"
    )
    links = own.table(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = own.table(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumped")
        moved = not jumped.where("moved").isEmpty()
        own.drop(links)
        links = jumped.select("word", "root")
        if not moved:
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
