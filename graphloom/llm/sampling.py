"""SentencePiece encoding and decoding, with distinct sampled segmentations by Gumbel top-k and A-star search."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, mix, text_blocks

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """A model's pieces with log weights, and a trie of them as arrays; one per worker.

    The scores of a unigram model are used as they are. Those of a BPE model are negative ranks;
    as frequencies fall about as one over the rank, a piece of rank r weighs 1 / (r + 10). Bytes,
    and runs of spaces, which have no rank, weigh like the last.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        size = self.model.get_piece_size()
        score = np.array([self.model.get_score(i) for i in range(size)])
        ranked = bool((score[score > -1e8] <= -size / 2).any())
        self.bytes = np.array([self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        last = -math.log(size + 10) if ranked else score[score > -1e8].min() - 1
        weight = np.where(score < -1e8, last, -np.log(10 - score) if ranked else score)
        weight[self.bytes] = last
        self.weight, self.fallback = weight, last
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in range(size):
            if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i):
                continue
            at = 0
            for c in self.model.id_to_piece(i):
                at = nodes.setdefault((at, ord(c)), len(ends))
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        keys, targets = np.array([s << 21 | c for s, c in nodes], np.int64), np.array(list(nodes.values()), np.int32)
        self.ends = np.array(ends, np.int32)
        # the trie's steps in a table of open addresses, a quarter full
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.targets = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            place, lead = np.unique(slot[free], return_index=True)
            new = np.flatnonzero(free)[lead]
            self.keys[place], self.targets[place] = keys[new], targets[new]
            keys, targets, slot = (np.delete(x, new) for x in (keys, targets, slot + 1))
        texts = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else self.model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.bytes.tolist()):
            texts[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(texts), np.uint8)
        self.spelt_size = np.array([len(t) for t in texts], np.int32)
        self.spelt_at = (np.cumsum(self.spelt_size) - self.spelt_size).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the trie's nodes have a step by these characters, and where those lead."""
        keys = state.astype(np.int64) << 21 | codes
        slot = self._slot(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] += 1
            found[open_] = self.keys[slot[open_]]
            open_ = open_[(found[open_] != keys[open_]) & (found[open_] >= 0)]
        hit = np.flatnonzero(found == keys)
        return hit, self.targets[slot[hit]]

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's end: what the model decodes them to, before it drops the leading space."""
        size = self.spelt_size[ids]
        end = np.cumsum(size)
        at = np.repeat(self.spelt_at[ids] - (end - size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.spelt[at], end


_LOADED: dict[str | None, Pieces] = {}


def pieces(path: str | None) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


@dataclass
class Lattice:
    """Edges of many words' lattices, sorted by start and then longest first: `first[p]` is a position's first edge, `stop[p]` its word's end."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    log_p: np.ndarray
    p: np.ndarray
    begin: np.ndarray
    codes: np.ndarray
    stop: np.ndarray


def lattice(own: Pieces, words: list[str]) -> Lattice:
    """Lattices of distinct words with, at each position, the probabilities of the pieces that leave it.

    Those are weights times what can follow, by sums from the words' ends; positions equally far
    from the end of their words are summed together.
    """
    lengths = np.array([len(w) for w in words], np.int32)
    begin = np.cumsum(lengths, dtype=np.int32) - lengths
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    stop = np.repeat(begin + lengths, lengths)
    at, state = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 0
    while len(at):
        hit, state = own.step(state, codes[at + depth])
        at = at[hit]
        depth += 1
        ends = own.ends[state]
        good = np.flatnonzero(ends >= 0)
        found.append((at[good], at[good] + np.int32(depth), ends[good]))
        more = np.flatnonzero(at + depth < stop[at])
        at, state = at[more], state[more]
    single = np.zeros(len(codes), bool)
    if found:
        single[found[0][0]] = True
    lone = np.flatnonzero(~single).astype(np.int32)  # characters without a piece are spelled in bytes: one edge of id -1
    found.insert(0, (lone, lone + np.int32(1), np.full(len(lone), -1, np.int32)))
    starts, ends, ids = (np.concatenate(x) for x in zip(*reversed(found), strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends, ids = starts[order], ends[order], ids[order]
    weight = own.weight[ids]
    bare = ids < 0
    weight[bare] = own.fallback * _utf8_size(codes[starts[bare]])
    first = np.concatenate(([0], np.cumsum(np.bincount(starts, minlength=len(codes)))))
    after = np.zeros(len(codes) + 1)
    far = stop - np.arange(len(codes), dtype=np.int32)
    by_far = np.argsort(far, kind="stable")
    cuts = np.searchsorted(far[by_far], np.arange(1, int(far.max(initial=0)) + 2))
    log_p = np.empty(len(starts))
    inner = ends < stop[starts]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        here = by_far[a:b]
        count = first[here + 1] - first[here]
        begins = np.cumsum(count) - count
        edges = np.repeat(first[here] - begins, count) + np.arange(count.sum())
        value = weight[edges] + np.where(inner[edges], after[ends[edges]], 0.0)
        top = np.maximum.reduceat(value, begins)
        total = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), begins))
        after[here] = total
        log_p[edges] = value - np.repeat(total, count)
    return Lattice(first, starts, ends, ids, log_p, np.exp(log_p), begin, codes, stop)


def _utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    """64-bit numbers that depend on nothing but the parts."""
    h = np.zeros(1, np.uint64)
    for k, part in enumerate(parts):
        h = mix((h + np.asarray(part).astype(np.uint64)) * np.uint64(2 * k + 0x9E3779B97F4A7C15) + np.uint64(k))
    return h


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of evenly spread hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _walk(g: Lattice, at: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample a path from each position to its word's end: all edges in order, and where each path begins among them.

    All paths take a step at a time. An edge is found by taking the edges' probabilities off a
    uniform number one after the other; the first one is the longest and mostly the one.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(at < stop)
    here, many = at[live], np.zeros(len(at), np.int64)
    while len(live):
        rest = _unit(mix(seed[live] + np.uint64((len(out) + 1) * 0xC2B2AE3D27D4EB4F % 2**64)))
        edge, last = g.first[here], g.first[here + 1] - 1
        rest -= g.p[edge]
        open_ = np.flatnonzero((rest >= 0) & (edge < last))
        while len(open_):
            edge[open_] += 1
            rest[open_] -= g.p[edge[open_]]
            open_ = open_[(rest[open_] >= 0) & (edge[open_] < last[open_])]
        out.append((live, edge))
        many[live] += 1
        here = g.end[edge]
        more = np.flatnonzero(here < stop[live])
        live, here = live[more], here[more]
    cut = np.concatenate(([0], np.cumsum(many)))
    edges = np.empty(cut[-1], np.int64)
    for k, (who, edge) in enumerate(out):
        edges[cut[who] + k] = edge
    return edges, cut


def _gumbel_below(limit: np.ndarray, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of subtrees of given log mass, given that they are below `limit`."""
    return -np.logaddexp(-limit, np.log(-np.log(u)) - log_mass)


def _spread(begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin, begin + 1, ... of each run, `many` each, and the number of the run."""
    run = np.repeat(np.arange(len(many)), many)
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(run)), run


def _best(text: np.ndarray, value: np.ndarray, want: int) -> np.ndarray:
    """Places of the `want` largest values of each text, texts in order, the largest first."""
    order = np.lexsort((-value, text))
    lead = np.searchsorted(text[order], text[order])
    return order[np.arange(len(order)) - lead < want]


def _heads(g: Lattice, edges: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray, prefix: np.ndarray, limit: np.ndarray, key: np.ndarray, turn: int, want: int) -> tuple[np.ndarray, ...]:
    """The best `want` subtrees that leave each path edges[begin:end] from its token `start` on: (path, value, token, edge, log mass).

    Tokens are read in lots, those of all paths together. What leaves a path behind them is one
    node, whose bound is its own perturbed mass; only where that is among the best are more
    tokens read, its value being the largest there.
    """
    found = tuple(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, float))
    live, at, lot = np.flatnonzero(begin + start < end), start.copy(), 24
    prefix, top, first_lot = prefix.copy(), np.zeros(len(begin)), True
    while len(live):
        many = np.minimum(lot, end[live] - begin[live] - at[live])
        place, run = _spread(begin[live] + at[live], many)
        own = edges[place]
        total = np.cumsum(g.log_p[own])
        lead = np.cumsum(many) - many
        base = prefix[live] - np.where(lead > 0, total[lead - 1], 0.0)
        before, behind = base[run] + total - g.log_p[own], base + total[lead + many - 1]
        where = g.start[own]
        count = g.first[where + 1] - g.first[where]
        edge, token = _spread(g.first[where], count)
        other = np.flatnonzero(edge != own[token])
        edge, token = edge[other], token[other]
        who, mass = live[run[token]], before[token] + g.log_p[edge]
        number = place[token] - begin[who]
        value = _gumbel_below(limit[who], mass, _unit(_hash(key[who], turn, 1 << 40, (number << 8) + edge - g.first[where[token]])))
        rest = begin[live] + at[live] + many < end[live]
        tail = np.where(rest, _gumbel_below(limit[live], behind, _unit(_hash(key[live], turn, 1 << 41, at[live]))), -np.inf)
        if not first_lot:  # the largest here is known
            z = tail.copy()
            np.maximum.at(z, run[token], value)
            with np.errstate(over="ignore", invalid="ignore"):
                shift = np.exp(-top[live]) - np.exp(-z)
                value = -np.log(np.maximum(shift[run[token]] + np.exp(-value), 1e-300))
                tail = np.where(rest, -np.log(np.maximum(shift + np.exp(-tail), 1e-300)), -np.inf)
        found = tuple(np.concatenate(x) for x in zip(found, (who, value, number, edge, mass), strict=True))
        held = _best(found[0], found[1], want)
        found = tuple(x[held] for x in found)
        filled = np.bincount(found[0], minlength=len(begin)) >= want
        least = np.full(len(begin), np.inf)
        np.minimum.at(least, found[0], found[1])
        more = rest & ~(filled[live] & (least[live] >= tail))
        prefix[live], top[live], at[live] = behind, tail, at[live] + many
        live, lot, first_lot = live[more], 2 * lot, False
    return found


@dataclass
class Drawn:
    """Segmentations of a block of texts, by text and rank; ids[cut[i]:cut[i + 1]] are one's."""

    text: np.ndarray
    rank: np.ndarray
    ids: np.ndarray
    cut: np.ndarray
    log_p: np.ndarray
    value: np.ndarray
    score: np.ndarray


def draw(own: Pieces, texts: list[str], keys: np.ndarray, n: int) -> Drawn:
    """`n` distinct segmentations of each text, or as many as there are, drawn without replacement.

    A segmentation's perturbed value is its log probability and a Gumbel variable, and the `n` of
    largest value are drawn. They are found from above: a subtree of the lattice has the largest
    value in it, of which its parts inherit one and draw the others below. Each turn takes the
    best subtree of every text, walks on from the edge that leads into it, and adds the subtrees
    that leave the new path to those that wait. The inclusion score is the log probability that a
    segmentation's value passes the (n+1)-th; it is 0 where there is none.
    """
    index: dict[str, int] = {}
    units = [_UNIT.findall((SPACE + t.replace(" ", SPACE)) if t else "") for t in texts]
    kind = np.array([index.setdefault(w, len(index)) for u in units for w in u], np.int64)
    unit_cut = np.concatenate(([0], np.cumsum([len(u) for u in units], dtype=np.int64)))
    some = np.flatnonzero(np.diff(unit_cut))
    text = np.repeat(np.arange(len(texts)), np.diff(unit_cut))
    g = lattice(own, list(index))
    del index, units
    limit = -np.log(-np.log(_unit(_hash(keys, 0, 1 << 42))))
    edges, cut = _walk(g, g.begin[kind], g.stop[g.begin[kind]] if len(kind) else g.begin[kind], _hash(keys[text], 0, np.arange(len(kind)) - unit_cut[text]))
    begin, end = cut[unit_cut[some]], cut[unit_cut[some + 1]]
    turns = [(some, np.zeros(len(some), np.int64), begin, end, limit[some])]  # text, turn, path in `edges`, value
    wait = [np.zeros(0, np.int64)] * 7
    token, mass = np.zeros(len(some), np.int64), np.zeros(len(some))
    for turn in range(n):
        who, _, begin, end, value = turns[-1]
        heads = _heads(g, edges, begin, end, token, mass, value, keys[who], turn, n - turn)
        new = (who[heads[0]], heads[1], begin[heads[0]], *heads[2:])  # text, value, path, token, edge, mass
        wait = [np.concatenate(x) for x in zip(wait, (*new, np.zeros(len(new[0]), bool)), strict=True)] if turn else [*new, np.zeros(len(new[0]), bool)]
        if turn == n - 1:
            break
        pick = np.flatnonzero(~wait[6])
        pick = pick[_best(wait[0][pick], wait[1][pick], 1)]
        wait[6][pick] = True
        who, value, source, token, edge, mass = (x[pick] for x in wait[:6])
        ends_word = np.concatenate(([0], np.cumsum(g.end[edges] == g.stop[g.start[edges]])))
        done = ends_word[source + token] - ends_word[source] + 1
        # the rest of the branch's word, and the words behind it, anew
        many = 1 + unit_cut[who + 1] - unit_cut[who] - done
        number, run = _spread(np.zeros(len(who), np.int64), many)
        rest = number == 0
        unit = kind[np.minimum(unit_cut[who[run]] + done[run] - 1 + number, len(kind) - 1)]
        at = np.where(rest, g.end[edge[run]], g.begin[unit])
        stop = np.where(rest, g.stop[g.start[edge[run]]], g.stop[g.begin[unit]])
        walked, cut = _walk(g, at, stop, _hash(keys[who[run]], turn + 1, np.where(rest, 1 << 43, done[run] - 1 + number)))
        first = np.cumsum(many) - many
        behind = cut[first + many] - cut[first]
        size = token + 1 + behind
        begin = np.cumsum(size) - size
        path = np.empty(size.sum(), np.int64)
        to, run = _spread(begin, token)
        path[to] = edges[_spread(source, token)[0]]
        path[begin + token] = edge
        path[_spread(begin + token + 1, behind)[0]] = walked
        turns.append((who, np.full(len(who), turn + 1), begin + len(edges), begin + size + len(edges), value))
        edges, token = np.concatenate((edges, path)), token + 1
    bound = np.full(len(texts), -np.inf)
    left = ~wait[6]
    np.maximum.at(bound, wait[0][left], wait[1][left])
    none = np.setdiff1d(np.arange(len(texts)), some)
    zero = np.zeros(len(none), np.int64)
    who, turn, begin, end, value = (np.concatenate(x) for x in zip(*turns, (none, zero, zero, zero, zero.astype(float)), strict=True))
    order = np.lexsort((turn, who))
    who, turn, begin, end, value = (x[order] for x in (who, turn, begin, end, value))
    total = np.concatenate(([0.0], np.cumsum(g.log_p[edges])))
    log_p = total[end] - total[begin]
    x = log_p - bound[who]
    with np.errstate(over="ignore", divide="ignore"):
        score = np.where(np.isinf(bound[who]), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 50.0))))))
    path, run = _spread(begin, end - begin)
    own_edges = edges[path]
    ids = g.piece[own_edges]
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        codes = g.codes[g.start[own_edges[bare]]]
        size = np.ones(len(ids), np.int64)
        size[bare] = _utf8_size(codes)
        at = np.cumsum(size) - size
        ids, run = np.repeat(ids, size), np.repeat(run, size)
        for k in range(4):
            held = size[bare] > k
            c, s = codes[held], size[bare][held]
            low = c >> (6 * (s - 1 - k))
            lead = np.where(s == 1, 0, (0xF00 >> s) & 0xFF)
            ids[at[bare[held]] + k] = own.bytes[low | lead if k == 0 else low & 0x3F | 0x80]
    return Drawn(who, turn + 1, ids, np.concatenate(([0], np.cumsum(np.bincount(run, minlength=len(who))))).astype(np.int64), log_p, value, score)


def segmentations(own: Pieces, texts: list[str], keys: np.ndarray, n: int) -> Iterator[tuple[int, int, list[int], float, float, float]]:
    """(text, rank, ids, log probability, perturbed log probability, log inclusion score) of what `draw` gives."""
    d = draw(own, texts, keys, n)
    for k in range(len(d.text)):
        yield int(d.text[k]), int(d.rank[k]), d.ids[d.cut[k] : d.cut[k + 1]].tolist(), float(d.log_p[k]), float(d.value[k]), float(d.score[k])


def sample(docs: DataFrame, n: int = 2, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, rank, ids, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, decoded_crc32): `n` distinct segmentations of each whole text.

    Draws depend on doc_id alone (null: 0), so a task that runs again gives the same, and rows
    that repeat a doc_id and text have equal samples. Null and empty texts have one segmentation,
    without pieces; texts with fewer than `n` have all of theirs. An empty table gives no rows.
    Without `with_ids` ids are null and only their checksum is given. The decoded text's checksum
    is that of the text itself, where no character of it is the mark that stands for a space.
    Columns other than doc_id and text are not read, whatever their names.
    """
    names = ["doc_id", "rank", "ids", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "decoded_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            ids_of = batch.column(0).cast(pa.int64())
            for first, last, block in text_blocks(batch.column(1), 4 << 20):
                keys = ids_of.slice(first, last - first).fill_null(0).to_numpy().view(np.uint64)
                d = draw(own, [t.decode("utf-8", "replace") for t in block], keys, n)
                raw, ends = own.spell(d.ids)
                ends = np.concatenate(([0], ends))[d.cut].tolist()
                cut, flat = d.cut.tolist(), d.ids.astype("<u4")
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                back = [zlib.crc32(raw[a + 1 : b]) if b > a else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(d.cut, pa.int32()), pa.array(d.ids, pa.int32())) if with_ids else pa.nulls(len(d.text), pa.list_(pa.int32()))
                columns = [ids_of.take(pa.array(d.text + first)), d.rank, ids, np.diff(d.cut), crc, d.log_p, d.value, d.score, back]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], names)

    return arrow_map(docs.select("doc_id", "text"), work, "doc_id long, rank int, ids array<int>, n_pieces int, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, decoded_crc32 long")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids): the model's own segmentation of each whole text; null and empty texts have no ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model).model
        for batch in batches:
            for first, last, block in text_blocks(batch.column(1)):
                ids = own.encode([t.decode("utf-8", "replace") for t in block], num_threads=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), work, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), the inverse of `encode` and of every sample; null ids give an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model).model
        for batch in batches:
            texts = [own.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(rows.select("doc_id", "ids"), work, "doc_id long, text string")
