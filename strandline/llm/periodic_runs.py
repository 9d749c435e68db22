"""Runs of repeated words: partition refinement of positions by equal factors, one word longer each round."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import bounded_batches, portions

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: A run of four periods holds each of its factors of one period's length so many times at least (some once more).
LEAST_MEMBERS = LEAST_PERIODS - 1
#: Characters of texts that are refined together.
TOGETHER = 1 << 22
_NEVER = np.int64(1) << 40


class Classes:
    """Positions of some word sequences in classes of equal factors of the present length.

    Classes never hold positions of two sequences; an empty slot follows each sequence. A class is a stretch of `perm` and a list
    in order of position (`after`, `before`). Of the classes that a round makes of one, all but the largest split the classes of
    the positions before theirs in the next round, so a position is moved as often as its class halves. Classes that are
    too small for a run are dropped, and then the positions before theirs, whose longer factors occur no more often.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """`words` holds the sequences, each with a slot behind it; `sizes` their lengths without that slot."""
        n = len(words)
        ends = np.cumsum(sizes + 1)
        self.starts, owner = ends - sizes - 1, np.repeat(np.arange(len(sizes)), sizes + 1)
        self.ends = ends - 1
        #: Longest period of a run of each sequence.
        self.limit = sizes // LEAST_PERIODS
        inside = np.ones(n, dtype=bool)
        inside[self.ends] = False
        inside &= self.limit[owner] >= 1
        places = np.flatnonzero(inside)
        key = (owner * (int(words.max(initial=0)) + 1) + words)[places]
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[by], prepend=-1))
        many = np.diff(np.append(first, len(by)))
        stay = many >= LEAST_MEMBERS
        self.perm = places[by[np.repeat(stay, many)]]
        room = len(self.perm) + 1
        self.first, self.size = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)
        self.used = int(stay.sum())
        self.size[: self.used] = many[stay]
        self.first[: self.used] = np.cumsum(many[stay]) - many[stay]
        self.cls = np.full(n, -1, dtype=np.int64)
        self.cls[self.perm] = np.repeat(np.arange(self.used), many[stay])
        self.loc = np.zeros(n, dtype=np.int64)
        self.loc[self.perm] = np.arange(len(self.perm))
        self.after, self.before = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        self.events: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.alive = len(self.perm)
        self._chain(self.perm.copy(), self.cls[self.perm], 1)
        # All words' classes are new in the first round; dropped words and the slots behind sequences have no class.
        self.refiners, self.gone = self.perm.copy(), np.flatnonzero(self.cls < 0)
        self.expiring = np.argsort(self.limit, kind="stable")[::-1].tolist()
        self.owner = owner

    def _chain(self, members: np.ndarray, classes: np.ndarray, length: int) -> None:
        """Link members, sorted by class and position, to lists; from this length on, their gaps are those to the next in the list."""
        same = np.flatnonzero(classes[1:] == classes[:-1])
        self.after[members], self.before[members] = -1, -1
        self.after[members[same]] = members[same + 1]
        self.before[members[same + 1]] = members[same]
        self._note(members, length)

    def _note(self, members: np.ndarray, length: int) -> None:
        following = self.after[members]
        self.events.append((members, np.where(following < 0, _NEVER, following - members), length))

    def _drop(self, members: np.ndarray, length: int) -> None:
        self.cls[members], self.after[members] = -1, -1
        self.alive -= len(members)
        self._note(members, length)

    def _expire(self, length: int) -> None:
        """Sequences that are too short for a run of this period leave whole."""
        while self.expiring and self.limit[self.expiring[-1]] < length:
            s = self.expiring.pop()
            inside = self.cls[self.starts[s] : self.ends[s]]
            self.alive -= int(np.count_nonzero(inside >= 0))
            inside[:] = -1

    def refine(self, length: int) -> None:
        """From classes of factors of `length` - 1 words to those of `length`."""
        self._expire(length)
        at = np.concatenate([self.gone, self.refiners]) - 1
        kind = np.concatenate([np.full(len(self.gone), -1), self.cls[self.refiners]])
        ok = (at >= 0) & (self.cls[at] >= 0)
        at, kind = at[ok], kind[ok]
        self.gone = self.refiners = _NO_PLACES
        if not len(at):
            return
        old = self.cls[at]
        by = np.lexsort((at, kind, old))
        at, kind, old = at[by], kind[by], old[by]
        new_old = np.diff(old, prepend=-1) != 0
        new_group = new_old | (np.diff(kind, prepend=-2) != 0)
        group = np.cumsum(new_group) - 1
        g_first = np.flatnonzero(new_group)
        g_old, g_kind, g_size = old[g_first], kind[g_first], np.diff(np.append(g_first, len(at)))
        # Where no member of a class is left over, its largest living group keeps the class's place.
        c_first = np.flatnonzero(np.diff(g_old, prepend=-1))
        c_of = np.cumsum(np.diff(g_old, prepend=-1) != 0) - 1
        c = g_old[c_first]
        rest = self.size[c] - np.add.reduceat(g_size, c_first)
        weight = np.where(g_kind < 0, 0, g_size)
        heaviest = np.lexsort((-weight, c_of))[c_first]
        keeps = np.zeros(len(g_first), dtype=bool)
        keeps[heaviest[(rest == 0) & (weight[heaviest] > 0)]] = True
        rest = rest + np.add.reduceat(np.where(keeps, g_size, 0), c_first)
        move = ~keeps[group]
        at, group = at[move], group[move]
        if not len(at):
            return
        self._move_out(at, self.cls[at], c, rest, length)
        # New classes lie at the end of the old one's stretch, in the order of the groups.
        lives = ~keeps & (g_kind >= 0) & (g_size >= LEAST_MEMBERS)
        names = np.where(lives, self.used + np.cumsum(lives) - 1, -1)
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        head_groups = group[heads]
        at_first = self.loc[at[heads]]
        living = lives[head_groups]
        made = names[head_groups[living]]
        self.first[made], self.size[made] = at_first[living], g_size[head_groups[living]]
        self.used += len(made)
        stays_alive = lives[group]
        fresh = at[stays_alive]
        self.cls[fresh] = names[group[stays_alive]]
        self._chain(fresh, self.cls[fresh], length)
        dropped = [at[~stays_alive]]
        self._drop(dropped[0], length)
        # What is left of a class may be too small.
        few = (rest > 0) & (rest < LEAST_MEMBERS)
        if few.any():
            left = self.perm[_ranges(self.first[c[few]], rest[few])]
            self._drop(left, length)
            dropped.append(left)
        self.gone = np.concatenate(dropped)
        # All but the largest of a class's children refine in the next round.
        kept = rest >= LEAST_MEMBERS
        child = np.concatenate([c[kept], made])
        parent = np.concatenate([np.flatnonzero(kept), c_of[head_groups[living]]])
        if len(child):
            size = self.size[child]
            by = np.lexsort((-size, parent))
            small = child[by][np.diff(parent[by], prepend=-1) == 0]
            self.refiners = self.perm[_ranges(self.first[small], self.size[small])]

    def _move_out(self, at: np.ndarray, old: np.ndarray, c: np.ndarray, rest: np.ndarray, length: int) -> None:
        """Take members, sorted by class and group, out of their classes' lists, and to the end of their classes' stretches of `perm`."""
        by = np.lexsort((at, old))
        line = at[by]
        linked = self.after[line[:-1]] == line[1:]
        heads, tails = np.append(True, ~linked), np.append(~linked, True)
        p, n = self.before[line[heads]], self.after[line[tails]]
        self.after[p[p >= 0]] = n[p >= 0]
        self.before[n[n >= 0]] = p[n >= 0]
        self._note(p[p >= 0], length)
        bound = np.repeat(self.first[c] + rest, self.size[c] - rest)
        slots = _ranges(self.first[c] + rest, self.size[c] - rest)
        moved = np.zeros(len(slots), dtype=bool)
        where = self.loc[at]
        inner = where < bound
        # Members that stay but lie in the end change places with those that move from before it.
        base = np.cumsum(self.size[c] - rest) - (self.size[c] - rest)
        nth = np.repeat(base - self.first[c] - rest, self.size[c] - rest)
        moved[(where + nth)[~inner]] = True
        stayers = self.perm[slots[~moved]]
        self.perm[where[inner]], self.loc[stayers] = stayers, where[inner]
        self.perm[slots], self.loc[at] = at, slots
        self.size[c] = rest

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and periods of all squares whose root is no power itself, in order of period and position.

        A square of period d starts where the next position with the same factor of d words is d words on; refines until no class is left.
        """
        length = 1
        while self.alive and self.expiring:
            length += 1
            self.refine(length)
        at = np.concatenate([e[0] for e in self.events])
        gap = np.concatenate([e[1] for e in self.events])
        since = np.repeat([e[2] for e in self.events], [len(e[0]) for e in self.events])
        by = np.argsort(at, kind="stable")  # a position's events keep their order
        at, gap, since = at[by], gap[by], since[by]
        until = np.full(len(at), _NEVER)
        again = at[1:] == at[:-1]
        until[:-1][again] = since[1:][again]
        found = (since <= gap) & (gap < until)
        found[found] = gap[found] <= self.limit[self.owner[at[found]]]
        by = np.lexsort((at[found], gap[found]))
        return at[found][by], gap[found][by]


_NO_PLACES = np.zeros(0, dtype=np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of some stretches, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def find_runs(words: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each sequence of word numbers, by start and period.

    Squares of one period that start at consecutive words are one run.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    if not (sizes >= LEAST_WORDS).any():
        return out
    slot = np.zeros(1, dtype=np.int64)
    classes = Classes(np.concatenate([x for w in words for x in (w, slot)]), sizes)
    at, period = classes.squares()
    if not len(at):
        return out
    heads = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(period, prepend=-1) != 0))
    length = np.diff(np.append(heads, len(at))) + 2 * period[heads] - 1
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period[heads])
    start, period, length = at[heads][long], period[heads][long], length[long]
    by = np.lexsort((period, start))
    for s, n, q in zip(start[by].tolist(), length[by].tolist(), period[by].tolist(), strict=True):
        i = int(classes.owner[s])
        out[i].append((s - int(classes.starts[i]), n, q))
    return out


def edited_sources(doc_id: int | None, n: int) -> np.ndarray:
    """The word of the text that stands at each place: itself, but in every tenth document (by the id's CRC) a stretch repeats from some word on.

    A null id leaves the words as they are.
    """
    places = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % p
    return places


def _row(words: list[bytes], source: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    kept = source[np.cumsum(edge[:-1]) == 0]
    collapsed = b" ".join([words[i] for i in kept.tolist()])
    facts = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *facts, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), runs, collapsed


def runs_of_texts(ids: list[int | None], texts: list[str]) -> list[tuple]:
    """Per text: number of runs, the best run's start, length, period and exponent, digests of the runs and of the collapsed text, both themselves."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sources = [edited_sources(i, len(w)) for i, w in zip(ids, split, strict=True)]
    numbers = [np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w))[s] for w, s in zip(split, sources, strict=True)]
    return [_row(*x) for x in zip(split, sources, find_runs(numbers), strict=True)]


def runs_of_documents(docs: DataFrame, with_runs: bool = False) -> DataFrame:
    """Runs of repeated words in every document's whole text, and the text without their repeats.

    Takes any frame with doc_id and text. Returns doc_id, n_runs, start, length, period and exponent_milli of the run with the
    most periods, runs_sha256 and collapsed_sha256, with `with_runs` also runs (array of start, length, period) and collapsed. Null texts are
    empty: no runs, and the digests of the empty string. A null id leaves the text unedited. Repeated rows stay as they are; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts, TOGETHER):
                part = ids.slice(a, b - a)
                rows = list(zip(*runs_of_texts(part.to_pylist(), texts[a:b]), strict=True))
                columns = {"doc_id": part}
                for name, values in zip(("n_runs", "start", "length", "period", "exponent_milli"), rows, strict=False):
                    columns[name] = pa.array(values, pa.int64())
                columns["runs_sha256"], columns["collapsed_sha256"] = pa.array(rows[5]), pa.array(rows[6])
                if with_runs:
                    triples = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in rows[7]]
                    columns["runs"] = pa.array(triples, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))
                    columns["collapsed"] = pa.array([c.decode("utf-8", "replace") for c in rows[8]])
                yield pa.record_batch(columns)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string" * with_runs
    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
