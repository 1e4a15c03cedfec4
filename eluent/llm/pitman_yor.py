"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Each word is the context of a restaurant whose customers are the words that follow it in training texts; an end stands before and after each text. All these restaurants share
one parent, whose customers are their tables and whose own base is even over the ``V`` known words and one unknown. A dish of ``c`` customers at ``t`` tables has in a
restaurant of ``C`` customers and ``T`` tables the probability ``(c - d t + (theta + d T) P) / (theta + C)``, with ``P`` from the parent.

Seating is sampled by Gibbs: a random customer of each dish leaves and sits down again, at a table of ``k`` customers with weight ``k - d``, at a new one with weight ``(theta + d T) P``. In a
round ``STEPS`` customers of each dish move in every restaurant while the parent stands still; then the parent is seated anew with their tables as its customers. A dish of one
customer has one table always, so that only dishes of more are carried from round to round. After ``BURN`` rounds the predictive probabilities of ``SAMPLES`` rounds are averaged.
Discounts come from the counts of counts, n1 / (n1 + 2 n2).

Pairs are dealt to buckets by their context; those of contexts with at least one in ``HOT`` of all words are dealt by both words, and the totals of these few restaurants are added up over
buckets. Words are dealt to buckets of their own. Buckets hand each other packed messages, so that each round moves only dishes of several customers. The model grows with the texts;
to score a text its pairs go, with those of some million other words, to the buckets, which send back a sum for each document. Nothing about the corpus is in one place but the list of words with at least one in
``LISTED`` of all words, which get short codes in messages.

Words are what stands between ASCII white space, with A-Z lower-cased. Null and empty texts are an end alone. A null doc_id is held out (as the empty text, whose crc32 is 0). Rows are documents of their
own whatever their ids; extra columns are ignored; without training texts every probability is 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, packed

BURN, SAMPLES, STEPS, THETA, SEED = 2, 3, 6, 1.0, 23
#: Words of a block of documents, and of all documents for each bucket.
BLOCK, BUCKET = 4_000_000, 2_000_000
HOT, LISTED = 400, 1 << 20
#: Sums for documents are sent in whole numbers of these parts.
MODEL_UNIT, PLAIN_UNIT = 10**6, 10**12
_RARE = np.uint64(1 << 63)
MESSAGE = "to int, kind string, src long, data binary, sums array<long>"


def _message(to: int, kind: str, src: int, data: bytes, sums: list[int] | None = None) -> dict:
    return {"to": to, "kind": kind, "src": src, "data": data, "sums": sums}


_ARROW = pa.schema([("to", pa.int32()), ("kind", pa.string()), ("src", pa.int64()), ("data", pa.binary()), ("sums", pa.list_(pa.int64()))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


# ---- seating ------------------------------------------------------------------------------------------------------


def _pick(rng: np.random.Generator, owner: np.ndarray, weight: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many of ``times`` draws of each owner fall on each of its entries (adjacent, from ``first``), by ``weight``."""
    many = times > 10_000
    out = np.zeros(len(weight), np.int64)
    ends = np.append(first[1:], len(weight))
    for i in np.flatnonzero(many):
        w = np.maximum(weight[first[i] : ends[i]], 0)
        out[first[i] : ends[i]] = rng.multinomial(times[i], w / w.sum())
    few = np.where(many, 0, times)
    top = np.cumsum(weight)
    below = top[first] - weight[first]
    of = np.repeat(np.arange(len(first)), few)
    at = np.searchsorted(top, below[of] + rng.random(len(of)) * (top[ends - 1] - below)[of], side="right")
    at = np.clip(at, first[of], ends[of] - 1)
    return out + np.bincount(at, minlength=len(weight))


def _sorted(owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(owner, kind="stable")
    return owner[order], size[order]


def seat(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seats ``c`` >= 1 customers of each dish one after another, a new table weighing ``a``; many at a time once there are many. The dish and size of each table."""
    done, left = [], np.arange(len(c))
    owner, size, n = np.arange(len(c)), np.ones(len(c), np.int64), 1
    while len(left):
        go = c[left] > n
        stay = go[owner]
        done.append((left[owner[~stay]], size[~stay]))
        left, owner, size = left[go], (np.cumsum(go) - 1)[owner[stay]], size[stay]
        if not len(left):
            break
        k = np.minimum(max(1, n // 8), c[left] - n)
        first = packed.runs(owner)
        t = np.diff(first, append=len(owner))
        new = rng.binomial(k, a[left] / (a[left] + n - d * t))
        size = size + _pick(rng, owner, size - d, first, k - new)
        owner, size = _sorted(np.concatenate((owner, np.repeat(np.arange(len(left)), new))), np.concatenate((size, np.ones(new.sum(), np.int64))))
        n += max(1, n // 8)
    return _sorted(np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])) if done else (owner, size)


def reseat(owner: np.ndarray, size: np.ndarray, c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs step for each dish (of at least two customers): a random customer leaves and sits down again."""
    if not len(c):
        return owner, size
    ones = np.ones(len(c), np.int64)
    size = size - _pick(rng, owner, size.astype(float), packed.runs(owner), ones)
    owner, size = owner[size > 0], size[size > 0]
    first = packed.runs(owner)
    t = np.diff(first, append=len(owner))
    new = rng.random(len(c)) * (a + c - 1 - d * t) < a
    size = size + _pick(rng, owner, size - d, first, ones - new)
    return _sorted(np.concatenate((owner, np.flatnonzero(new))), np.concatenate((size, np.ones(new.sum(), np.int64))))


# ---- blocks of documents --------------------------------------------------------------------------------------------


def _tokenised(size: int):
    """Blocks of about ``size`` words: their words as numbers, the hash of each number's word (0 the end), and their documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, parts, ids, held, tokens = packed.Codes({b"": 0}), [], [], [], 0
        number = TaskContext.get().partitionId() << 24

        def block() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, codes), np.uint64, len(codes))
            null = np.array([x is None for x in ids], bool)
            data = packed.pack(tokens=np.concatenate(parts), n=np.array([len(x) for x in parts], np.int32), hash=words, id=np.array([x or 0 for x in ids], np.int64), null=null, held=np.array(held, bool))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])

        for b in it:
            for doc_id, text, out in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = text.lower().split()
                parts.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                held.append(out)
                tokens += len(words) + 1
                if tokens >= size:
                    yield block()
                    codes, parts, ids, held, tokens, number = packed.Codes({b"": 0}), [], [], [], 0, number + 1
        if parts:
            yield block()

    return run


def _listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, hash, n: 0 words of some share of a block by hash, 1 tokens, 2 training tokens, 3 training documents."""
    for b in it:
        for data in b.column(1).to_pylist():
            x = packed.unpack(data)
            counts, own = np.bincount(x["tokens"], minlength=len(x["hash"])), x["n"].astype(np.int64) + 1
            some = np.flatnonzero(counts * LISTED >= own.sum())
            sums = [own.sum(), own[~x["held"]].sum(), (~x["held"]).sum()]
            kind = np.concatenate((np.zeros(len(some), np.int32), np.arange(1, 4, dtype=np.int32)))
            hashes = np.concatenate((x["hash"][some], np.zeros(3, np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(hashes), pa.array(np.concatenate((counts[some], sums)).astype(np.int64))], names=["kind", "hash", "n"])


class Coding:
    """Keys of words: 0 is the end, listed words have their place in the list, others a hash. Buckets of pairs and words."""

    def __init__(self, listed: np.ndarray, n_hot: int, buckets: int):
        """``listed``: hashes, the most frequent first, of which the first ``n_hot`` are hot."""
        self.rank = np.argsort(listed)
        self.hashes, self.buckets = listed[self.rank], buckets
        self.hot = np.arange(n_hot + 1, dtype=np.uint64)  # the end too

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Of hashes of words."""
        if not len(self.hashes):
            return h | _RARE
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, (self.rank[at] + 1).astype(np.uint64), h | _RARE)

    def of_pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        mix = common.mixed(np.where(u < len(self.hot), common.mixed(u + np.uint64(7)) + w, u))
        return (mix % np.uint64(self.buckets)).astype(np.int64)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return (common.mixed(w ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.buckets)).astype(np.int64)


class Block:
    """The pairs of a block of documents, each once, with the documents of its occurrences."""

    def __init__(self, x: dict[str, np.ndarray], coding: Coding):
        keys = np.concatenate((np.zeros(1, np.uint64), coding.keys(x["hash"][1:])))
        self.n = x["n"].astype(np.int64) + 1
        ends = np.cumsum(self.n)
        tokens = np.zeros(int(ends[-1]) + 1, np.uint32)  # an end before each document, and one after the last
        place = np.ones(len(tokens), bool)
        place[np.concatenate(([0], ends))] = False
        tokens[place] = x["tokens"]
        doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        bits, doc_bits = len(keys).bit_length(), len(self.n).bit_length()
        pair = tokens[:-1].astype(np.int64)  # in place from here on: a block is the most that a task holds
        pair <<= bits
        pair |= tokens[1:]
        if 2 * bits + doc_bits <= 63:
            pair <<= doc_bits
            pair |= doc
            pair.sort()
            doc = (pair & (1 << doc_bits) - 1).astype(np.int32)
            pair >>= doc_bits
        else:
            order = np.argsort(pair, kind="stable")
            pair, doc = pair[order], doc[order]
        self.start, self.doc = packed.runs(pair), doc
        pair = pair[self.start]
        self.u, self.w = keys[pair >> bits], keys[pair & (1 << bits) - 1]


def _coded(u: np.ndarray, w: np.ndarray, **more: np.ndarray) -> bytes:
    """Pairs with equal ``u`` next to each other."""
    start, listed = packed.runs(u), w < _RARE
    return packed.pack(u=u[start], un=np.diff(start, append=len(u)).astype(np.int32), listed=np.packbits(listed), small=w[listed].astype(np.uint32), large=w[~listed], **more)


def _decoded(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u = np.repeat(x["u"], x["un"])
    listed = np.unpackbits(x["listed"], count=len(u)).astype(bool)
    w = np.empty(len(u), np.uint64)
    w[listed], w[~listed] = x["small"], x["large"]
    return u, w


def _pairs(coding: Coding, scored: bool):
    """Each block's pairs for each bucket, with training counts; if ``scored``, with the documents of their occurrences, and a message of the documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from messages(number, packed.unpack(data))

    def messages(number: int, x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        block, held = Block(x, coding), x["held"]
        times = np.diff(block.start, append=len(block.doc))
        train = np.add.reduceat(~held[block.doc], block.start, dtype=np.int32)
        bucket = coding.of_pairs(block.u, block.w)
        order = np.argsort(bucket.astype(np.uint16) if coding.buckets <= 1 << 16 else bucket, kind="stable")
        for i, j in packed.cuts(bucket[order]):
            own = order[i:j]
            more = {"c": train[own]}
            if scored:
                n = times[own]
                first = np.cumsum(n) - n
                doc = block.doc[np.repeat(block.start[own] - first, n) + np.arange(n.sum())].astype(np.int64)
                step = np.diff(doc, prepend=0)  # a pair's documents ascend; steps between them are small
                step[first] = doc[first]
                more |= {"times": n.astype(np.int32), "step": step.astype(np.int32)}
            yield _batch([_message(int(bucket[own[0]]), "pairs", number, _coded(block.u[own], block.w[own], **more))])
        if scored:
            data = packed.pack(id=x["id"], null=x["null"], held=held, n=block.n)
            yield _batch([_message(number % coding.buckets, "docs", number, data)])

    return run


# ---- buckets ------------------------------------------------------------------------------------------------------------


def _rows(group: pa.Table, kind: str) -> list[tuple[int, dict[str, np.ndarray]]]:
    """(src, arrays) of the messages of a kind, in the order of src."""
    of = [(s, d) for s, k, d in zip(group["src"].to_pylist(), group["kind"].to_pylist(), group["data"].to_pylist(), strict=True) if k == kind]
    return [(s, packed.unpack(d)) for s, d in sorted(of, key=lambda x: x[0])]


def _joined(rows: list[tuple[int, dict]], name: str, kind: type) -> np.ndarray:
    return np.concatenate([x[name] for _, x in rows]) if rows else np.zeros(0, kind)


def _merged(rows: list[tuple[int, dict]]):
    """Contexts, words, and for each pair of all messages the places of its two; each pair once, and which of these each one is."""
    cut = [_decoded(x) for _, x in rows]
    u, ui = np.unique(np.concatenate([x[0] for x in cut]), return_inverse=True)
    w, wi = np.unique(np.concatenate([x[1] for x in cut]), return_inverse=True)
    pair, where = np.unique(ui << 32 | wi, return_inverse=True)
    c = np.zeros(len(pair), np.int64)
    np.add.at(c, where, _joined(rows, "c", np.int32))
    return u, w, pair >> 32, pair & 0xFFFFFFFF, where, c


def _to_words(coding: Coding, kind: str, src: int, w: np.ndarray, **of: np.ndarray) -> list[dict]:
    """Messages about words (each once) to their buckets."""
    to = coding.of_words(w)
    order = np.argsort(to, kind="stable")
    return [_message(int(to[order[i]]), kind, src, packed.pack(w=w[order[i:j]], **{k: x[order[i:j]] for k, x in of.items()})) for i, j in packed.cuts(to[order])]


def _first(coding: Coding):
    """From training counts: dishes of several customers, those of one by word, and sums: dishes of one and two customers, contexts that are not hot, then the hot
    contexts' customers and tables."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group["to"][0].as_py()
        u, w, ui, wi, _, c = _merged(_rows(group, "pairs"))
        hot = len(coding.hot)
        several = c > 1
        ones = np.bincount(ui[c == 1], minlength=len(u))
        total = np.zeros(len(u), np.int64)
        np.add.at(total, ui, c)
        sums = np.zeros(3 + 2 * hot, np.int64)
        sums[:3] = (c == 1).sum(), (c == 2).sum(), ((total > 0) & (u >= hot)).sum()
        is_hot = u < hot
        sums[3 + u[is_hot].astype(np.int64)] = total[is_hot]
        sums[3 + hot + u[is_hot].astype(np.int64)] = (np.bincount(ui[c > 0], minlength=len(u)))[is_hot]
        kept = np.unique(ui[several])
        hot_ones = np.zeros(hot, np.int64)
        hot_ones[u[is_hot].astype(np.int64)] = ones[is_hot]
        state = _coded(u[ui[several]], w[wi[several]], c=c[several], ones=ones[kept], hot_ones=hot_ones)
        rows = [_message(bucket, "state", bucket, state, sums.tolist())]
        rows += _to_words(coding, "asks", bucket, w, one=np.bincount(wi[c == 1], minlength=len(w)).astype(np.int32), several=np.bincount(wi[several], minlength=len(w)).astype(np.int32))
        more, n = np.unique(wi[several], return_counts=True)
        return pa.Table.from_pylist(rows + _to_words(coding, "tables", bucket, w[more], n=n.astype(np.int64)), schema=_ARROW)

    return run


def _words(group: pa.Table) -> pa.Table:
    """Each word of a bucket with the number of contexts where it has one customer; sums: words, and those with one and two tables if each dish has one."""
    rows = _rows(group, "asks")
    w, where = np.unique(_joined(rows, "w", np.uint64), return_inverse=True)
    one, several = (np.bincount(where, _joined(rows, k, np.int32), minlength=len(w)).astype(np.int64) for k in ("one", "several"))
    some = one + several > 0
    first = (one + several)[some]
    to = group["to"][0].as_py()
    return pa.Table.from_pylist([_message(to, "words", to, packed.pack(w=w[some], one=one[some]), [int(some.sum()), int((first == 1).sum()), int((first == 2).sum())])], schema=_ARROW)


def _parent(turn: int, base: float, d: float, keep: bool):
    """Seats the tables of all contexts by word: what of each word's probability is its own, for the buckets that sent tables; sums: customers and tables."""

    def run(group: pa.Table) -> pa.Table:
        to = group["to"][0].as_py()
        rng = np.random.default_rng([SEED, turn, 0, to])
        words = _rows(group, "words")
        if not words:
            return _ARROW.empty_table()
        words, tables = words[0][1], _rows(group, "tables")
        w, c = words["w"], words["one"].copy()
        np.add.at(c, np.searchsorted(w, _joined(tables, "w", np.uint64)), _joined(tables, "n", np.int64))
        a = np.full(len(c), base)
        owner, size = seat(c, a, d, rng)
        more = np.flatnonzero(c > 1)
        for _ in range(STEPS):
            several = c[owner] > 1
            o, s = reseat(np.searchsorted(more, owner[several]), size[several], c[more], a[more], d, rng)
            owner, size = _sorted(np.concatenate((owner[~several], more[o])), np.concatenate((size[~several], s)))
        own = c - d * np.bincount(owner, minlength=len(c))
        if keep:
            words |= {f"own{turn}": own.astype(np.float32)}
        rows = [_message(to, "words", to, packed.pack(**words), [int(c.sum()), len(size)])]
        rows += [_message(src, "own", to, packed.pack(w=x["w"], own=own[np.searchsorted(w, x["w"])])) for src, x in tables]
        return pa.Table.from_pylist(rows, schema=_ARROW)

    return run


def _contexts(coding: Coding, turn: int, d: float, parent: Callable[[np.ndarray], np.ndarray], hot_tables: np.ndarray, keep: bool, last: bool):
    """Moves customers of the dishes of several; their tables by word, unless this is the last round; sums: tables of hot contexts."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group["to"][0].as_py()
        rng = np.random.default_rng([SEED, turn, 1, bucket])
        ((_, x),), own = _rows(group, "state"), _rows(group, "own")
        u, w = _decoded(x)
        contexts, ui = np.unique(u, return_inverse=True)
        ones = x["ones"]
        names, values = _joined(own, "w", np.uint64), _joined(own, "own", float)
        order = np.argsort(names)
        p, c = parent(values[order][np.searchsorted(names[order], w)]), x["c"]
        hot = contexts < len(hot_tables)
        places = contexts[hot].astype(np.int64)

        def weight(t: np.ndarray) -> np.ndarray:
            tables = ones + np.bincount(ui, t, minlength=len(contexts))
            tables[hot] = hot_tables[places]
            return (THETA + d * tables[ui]) * p

        if "size" in x:
            owner, size = np.repeat(np.arange(len(c)), x["t"]), x["size"].astype(np.int64)
        else:
            owner, size = seat(c, weight(np.ones(len(c))), d, rng)
        for _ in range(STEPS):
            owner, size = reseat(owner, size, c, weight(np.bincount(owner, minlength=len(c))), d, rng)
        t = np.bincount(owner, minlength=len(c))
        more = {k: v for k, v in x.items() if k[0] == "t" and k[1:].isdigit()} | ({f"t{turn}": t.astype(np.int32)} if keep else {})
        sums = x["hot_ones"].copy()
        sums[places] += np.bincount(ui, t, minlength=len(contexts)).astype(np.int64)[hot]
        state = _coded(u, w, c=c, ones=ones, hot_ones=x["hot_ones"], t=t.astype(np.int32), size=size, **more)
        names, wi = np.unique(w, return_inverse=True)
        rows = [_message(bucket, "state", bucket, state, sums.tolist())]
        rows += [] if last else _to_words(coding, "tables", bucket, names, n=np.bincount(wi, t).astype(np.int64))
        return pa.Table.from_pylist(rows, schema=_ARROW)

    return run


def _answers(turns: list[int]):
    """For each bucket, what of the probability of the words in its texts is their own, in each sample."""

    def run(group: pa.Table) -> pa.Table:
        words = _rows(group, "words")
        rows = []
        for src, x in _rows(group, "asks"):
            out = {f"own{t}": np.zeros(len(x["w"]), np.float32) for t in turns}
            if words:
                known = words[0][1]["w"]
                at = np.minimum(np.searchsorted(known, x["w"]), len(known) - 1)
                there = known[at] == x["w"] if len(known) else np.zeros(len(x["w"]), bool)
                for t in turns:
                    out[f"own{t}"][there] = words[0][1][f"own{t}"][at[there]]
            rows.append(_message(src, "answers", group["to"][0].as_py(), packed.pack(**out)))  # in the order asked
        return pa.Table.from_pylist(rows, schema=_ARROW)

    return run


class Sample:
    """What a round leaves for all buckets: the parent's share that falls on every word, its size, and the hot contexts' tables."""

    def __init__(self, turn: int, d: float, customers: int, tables: int, words: int):
        self.turn, self.even, self.size = turn, (THETA + d * tables) / (words + 1), THETA + customers
        self.hot_tables: np.ndarray = np.zeros(0, np.int64)

    def parent(self, own: np.ndarray) -> np.ndarray:
        return (own.astype(float) + self.even) / self.size


def _scores(coding: Coding, d: float, samples: list[Sample], hot_customers: np.ndarray, base: Callable[[np.ndarray], np.ndarray]):
    """Sums for each document with pairs in the bucket: log10 probabilities of the model and of the base, known words."""

    def run(group: pa.Table) -> pa.Table:
        docs = [_message(0, "docs", s, d_) for s, k, d_ in zip(group["src"].to_pylist(), group["kind"].to_pylist(), group["data"].to_pylist(), strict=True) if k == "docs"]
        pairs = _rows(group, "pairs")
        if not pairs:
            return pa.Table.from_pylist(docs, schema=_ARROW)
        u, w, ui, wi, where, c = _merged(pairs)
        hot = u < len(hot_customers)
        places = u[hot].astype(np.int64)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, ui, c)
        total[hot] = hot_customers[places]
        answers = _rows(group, "answers")  # of each bucket of words, which was asked about these words in this order
        asked = np.argsort(coding.of_words(w), kind="stable")
        several = np.flatnonzero(c > 1)  # in the order of contexts and words, as in the state
        x = _rows(group, "state")[0][1]
        p = np.zeros(len(c))
        for s in samples:
            t = (c > 0).astype(np.int64)
            if len(several):
                t[several] = x[f"t{s.turn}"]
            tables = np.bincount(ui, t, minlength=len(u))
            tables[hot] = s.hot_tables[places]
            above = np.empty(len(w))
            above[asked] = s.parent(_joined(answers, f"own{s.turn}", np.float32))
            p += (c - d * t + (THETA + d * tables[ui]) * above[wi]) / (THETA + total[ui])
        model, plain = np.log10(p / len(samples)), np.where(u == 0, 0.0, base(total))
        known, at, rows = (total > 0) & (u > 0), 0, []
        for src, m in pairs:
            own = where[at : at + len(m["times"])]
            at += len(own)
            of, steps = np.repeat(own, m["times"]), np.cumsum(m["step"], dtype=np.int64)
            first = np.cumsum(m["times"]) - m["times"]
            doc = steps - np.repeat(steps[first] - m["step"][first], m["times"])
            n = doc.max() + 1
            sums = [np.bincount(doc, v, minlength=n) for v in (model[of], plain[ui[of]], known[ui[of]])]
            some = np.unique(doc)
            whole = [np.rint(x[some] * unit).astype(np.int64) for x, unit in zip(sums, (MODEL_UNIT, PLAIN_UNIT, 1), strict=True)]
            rows.append(_message(0, "sums", src, packed.pack(doc=some.astype(np.int32), model=whole[0], plain=whole[1], known=whole[2])))
        return pa.Table.from_pylist(docs + rows, schema=_ARROW)

    return run


def _documents(train_tokens: int, ends: int, of_end: float):
    def run(group: pa.Table) -> pa.Table:
        ((_, x),), sums = _rows(group, "docs"), _rows(group, "sums")
        n = len(x["id"])
        doc = _joined(sums, "doc", np.int32)
        model, plain, known = (np.bincount(doc, _joined(sums, k, np.int64) / unit, minlength=n) for k, unit in (("model", MODEL_UNIT), ("plain", PLAIN_UNIT), ("known", 1)))
        return pa.table({
            "doc_id": pa.array(x["id"], mask=x["null"]), "held_out": pa.array(x["held"]), "n_tokens": pa.array(x["n"]), "n_known": pa.array(known.astype(np.int64) + (ends > 0)),
            "train_tokens": pa.array(np.full(n, train_tokens)), "base_score": pa.array(plain + of_end), "score": pa.array(model),
        })

    return run


# ---- the whole ----------------------------------------------------------------------------------------------------------


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _added(df: DataFrame, kind: str) -> np.ndarray:
    """The sums of a kind of message, place by place: a few numbers, and two for each of some hundred hot contexts."""
    rows = df.where(F.col("kind") == kind).select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    out = np.zeros(len(rows), np.int64)
    for r in rows:
        out[r["pos"]] = r["n"]
    return out


def discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def scores(docs: DataFrame, held: Column | None = None, bucket: int = BUCKET, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``; rows that are not ``held`` train the model."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out() if held is None else held, F.lit(True)).alias("held"))
    blocks = common.saved(docs.mapInArrow(_tokenised(block), "block long, data binary"), "blocks")
    counts = common.saved(blocks.mapInArrow(_listed, "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n")), "listed")
    all_tokens, train_tokens, ends = (counts.where(F.col("kind") == k).agg(F.sum("n")).first()[0] or 0 for k in (1, 2, 3))
    if not all_tokens:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    listed = counts.where((F.col("kind") == 0) & (F.col("n") * LISTED >= all_tokens)).orderBy(F.desc("n"), "hash").collect()  # LISTED rows at most
    coding = Coding(np.array([r["hash"] for r in listed], np.int64).view(np.uint64), sum(r["n"] * hot >= all_tokens for r in listed), max(1, -(-all_tokens // bucket)))

    by = lambda df, f: df.groupBy("to").applyInArrow(f, MESSAGE)
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    first = common.saved(by(blocks.mapInArrow(_pairs(coding, False), MESSAGE), _first(coding)), "first")
    common.release(spark)
    sums, n_hot = _added(first, "state"), len(coding.hot)
    hot_customers, hot_tables = sums[3 : 3 + n_hot], sums[3 + n_hot :]
    n_words = int(sums[2] + (hot_customers > 0).sum())
    d = discount(*sums[:2])
    words = common.saved(by(of(first, "asks"), _words), "words")
    d_parent = discount(*_added(words, "words")[1:])
    tables, state, base, samples = first, first, THETA / (n_words + 1) + d_parent, []
    for turn in range(BURN + SAMPLES):
        made, keep = common.made(), turn >= BURN
        parent = common.saved(by(of(words, "words").union(of(tables, "tables")), _parent(turn, base, d_parent, keep)), "parent")
        seated = _added(parent, "words")
        now = Sample(turn, d_parent, *(seated.tolist() if len(seated) else (0, 0)), n_words)
        base = now.even
        state = common.saved(by(of(state, "state").union(of(parent, "own")), _contexts(coding, turn, d, now.parent, hot_tables, keep, turn == BURN + SAMPLES - 1)), "state")
        hot_tables = _added(state, "state")
        now.hot_tables = hot_tables
        samples += [now] if keep else []
        words, tables = parent, state
        if turn:
            common.discard(spark, made - 2, made)  # the round before
        common.release(spark)
    asked = by(of(first, "asks").union(of(words, "words")), _answers([s.turn for s in samples]))
    met = blocks.mapInArrow(_pairs(coding, True), MESSAGE).union(asked).union(of(state, "state"))
    all_words = train_tokens + 0.1 * (n_words + 1)
    of_count = lambda c: np.log10((c + 0.1) / all_words)
    sums = by(met, _scores(coding, d, samples, hot_customers, of_count))
    return sums.groupBy("src").applyInArrow(_documents(train_tokens, ends, float(of_count(ends))), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
