"""Byte-level BPE encoding and decoding, with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import python_ready, python_task, slices

#: Unicode's White_Space characters, and the split pattern of this vocabulary with that class for \s.
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
#: Bytes of words kept with their ids, some ENTRY of them for each beside its own, by each worker before it starts anew.
KEPT, ENTRY = 72 << 20, 200
#: Longer words are not kept; symbols merged at a time; characters of text coded at a time.
LONG, BATCH, TEXTS = 64, 1 << 17, 1 << 19
#: Words of a like length are merged one by one where each is over so many times longer than their number.
ALONE = 256

_NONE = 1 << 62
_SHIFT = 32
_LOW = (1 << _SHIFT) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairTrees:
    """Segment trees over the adjacent pairs of many words of like length, one tree a row.

    Leaf i of a tree is the pair of symbol i and the next one: its rank above, i below. So the root is the lowest
    rank, and of equals the leftmost. A round merges the root's pair of every row that has one: three leaves change,
    and their minima up to the root, which takes three times the logarithm of the length.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, pairs: Pairs):
        """ids: a row of symbols for each word, and one column more than a power of two; lengths: of the words."""
        rows, width = ids.shape
        self.ids, self.pairs, self.size = ids, pairs, width - 1
        at = np.arange(width)
        self.after = np.where(at + 1 < lengths[:, None], at + 1, -1)
        self.before = np.broadcast_to(at - 1, ids.shape).copy()
        tree = np.full((rows, 2 * self.size), _NONE, np.int64)
        real = at[:-1] + 1 < lengths[:, None]
        tree[:, self.size :][real] = pairs.leaf(ids[:, :-1][real], ids[:, 1:][real], np.broadcast_to(at[:-1], real.shape)[real])
        k = self.size
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        self.tree = tree

    def merge_all(self) -> np.ndarray:
        """The ids once no pair can merge; symbols that went are -1."""
        size, ids, after, before = self.size, self.ids.ravel(), self.after.ravel(), self.before.ravel()
        tree, row = self.tree.ravel(), np.arange(len(self.ids))
        while True:
            top = tree[row * (2 * size) + 1]
            going = top < _NONE
            row, top = row[going], top[going]
            if not len(row):
                return self.ids
            own, base = row * (size + 1), row * (2 * size)
            i = top & _LOW
            j = after[own + i]
            new = self.pairs.made[top >> _SHIFT]
            ids[own + i] = new
            ids[own + j] = -1
            k = after[own + j]
            after[own + i] = k
            follows = k >= 0
            before[(own + k)[follows]] = i[follows]
            p = before[own + i]
            led = p >= 0
            leaves = [np.where(j < size, j, i), i, np.where(led, p, i)]
            tree[base + size + leaves[0]] = _NONE
            right = np.full(len(row), _NONE, np.int64)
            right[follows] = self.pairs.leaf(new[follows], ids[(own + k)[follows]], i[follows])
            tree[base + size + i] = right
            tree[(base + size + p)[led]] = self.pairs.leaf(ids[(own + p)[led]], new[led], p[led])
            nodes = [(x + size) >> 1 for x in leaves]
            while nodes[0][0]:
                for x in nodes:
                    tree[base + x] = np.minimum(tree[base + 2 * x], tree[base + 2 * x + 1])
                nodes = [x >> 1 for x in nodes]


class PairTree:
    """The same for one word, in plain lists: quicker where words are so long that few are merged together."""

    def __init__(self, ids: list[int], pairs: Pairs):
        n = len(ids)
        self.ids, self.pairs, self.size = ids, pairs, 1 << max(n - 2, 0).bit_length()
        first = np.array(ids, np.int64)
        self.tree = [_NONE] * (2 * self.size)
        if n > 1:
            self.tree[self.size : self.size + n - 1] = pairs.leaf(first[:-1], first[1:], np.arange(n - 1)).tolist()
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def _set(self, at: int, value: int) -> None:
        tree, k = self.tree, at + self.size
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    def merge_all(self) -> tuple[int, ...]:
        ids, n, made, rank = self.ids, len(self.ids), self.pairs.new_ids, self.pairs.ranks.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def leaf(a: int, b: int) -> int:
            r = rank(ids[a] << _SHIFT | ids[b])
            return _NONE if r is None else r << _SHIFT | a

        while (top := self.tree[1]) < _NONE:
            i = top & _LOW
            j = after[i]
            ids[i] = made[top >> _SHIFT]
            ids[j] = -1
            k = after[i] = after[j]
            if j < self.size:
                self._set(j, _NONE)
            if k >= 0:
                before[k] = i
            self._set(i, leaf(i, k) if k >= 0 else _NONE)
            if (p := before[i]) >= 0:
                self._set(p, leaf(p, i))
        return tuple(x for x in ids if x >= 0)


class Pairs:
    """The pairs that merge: looked up for many at once."""

    def __init__(self, pairs: Sequence[tuple[int, int, int]]):
        """(left id, right id, id made), by rank."""
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = left << _SHIFT | right
        self.made, self.order = made, np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.new_ids = made.tolist()

    @cached_property
    def ranks(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.order.tolist(), strict=True))

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank above, position below; _NONE for a pair that does not merge."""
        key = left << _SHIFT | right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.order[k] << _SHIFT | at, _NONE)


#: What a tokenizers file must say for its texts to be coded as here; it may leave out what is None or False.
PARTS = {"normalizer": {}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"}}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def supported(spec: dict) -> None:
    """ValueError for a vocabulary that is not byte-level BPE with the usual split, or whose added tokens strip or match whole words."""
    parts = [(spec.get(k) or {}, known) for k, known in PARTS.items()] + [(spec["model"], MODEL), *((x, ADDED) for x in spec["added_tokens"])]
    for own, known in parts:
        if not known and own or any((own.get(k) or None) != (v or None) for k, v in known.items()):
            raise ValueError(f"not supported: {({k: v for k, v in own.items() if k not in ('vocab', 'merges')})}; only {known}")


class Coder:
    """Encodes and decodes as the vocabulary in a tokenizers file says."""

    def __init__(self, text: str):
        spec = json.loads(text)
        supported(spec)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges = (pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"])
        self.pairs = Pairs([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.names = [str(i) for i in range(len(self.bytes))]
        self.pieces = regex.compile(SPLIT).findall
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}
        self.kept = 0
        self.risky = re.compile(rf" [{WS}]").search
        self.segments = re.compile(rf"[{WS}]*[^{WS}]+|[{WS}]+").findall
        self.split_added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

    def merge(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each piece, 4 bytes each, at most BATCH symbols at a time."""
        found = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(1 << max(len(w) - 2, 0).bit_length(), []).append(k)
        for size, all_of in by_size.items():
            if size >= ALONE * len(all_of):
                for k in all_of:
                    found[k] = np.array(PairTree(self.first[np.frombuffer(words[k], np.uint8)].tolist(), self.pairs).merge_all(), np.int32).tobytes()
                continue
            step = max(1, BATCH // size)
            for at in range(0, len(all_of), step):
                some = all_of[at : at + step]
                lengths = np.fromiter((len(words[k]) for k in some), np.int64, len(some))
                ids = np.full((len(some), size + 1), -1, np.int64)
                ids[np.arange(size + 1) < lengths[:, None]] = self.first[np.frombuffer(b"".join(words[k] for k in some), np.uint8)]
                ids = PairTrees(ids, lengths, self.pairs).merge_all()
                left = ids >= 0
                flat, ends = ids[left].astype(np.int32).tobytes(), (4 * np.cumsum(left.sum(1))).tolist()
                for k, a, b in zip(some, [0, *ends], ends, strict=False):
                    found[k] = flat[a:b]
        return found

    def _learn(self, known: dict[str, bytes], texts: set[str], lead: str) -> None:
        """Adds to known the ids of these texts, each with lead before it."""
        whole, cut = [], []
        for x in texts:
            if x.isalpha():
                whole.append(x)
            elif x[-1:] in ",." and x[:-1].isalpha():
                cut.append((x, (lead + x[:-1], x[-1])))
            else:
                cut.append((x, self.pieces(lead + x)))
        known.update(zip(whole, self.merge([(lead + x).encode() for x in whole]), strict=True))
        new = list({p for _, pieces in cut for p in pieces}.difference(self.words))
        self.words.update(zip(new, self.merge([x.encode() for x in new]), strict=True))
        word = self.words.__getitem__
        for x, pieces in cut:
            known[x] = b"".join(map(word, pieces))
        for learnt, by in ((texts, known), (new, self.words)):
            self.kept += ENTRY * len(learnt) + sum(map(len, learnt)) + sum(map(len, map(by.__getitem__, learnt)))

    def encode(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each text. Pieces that these texts bring are merged together."""
        if self.kept > KEPT:
            self.kept = 0
            for known in (self.words, self.chunks, self.after):
                known.clear()
        plans, chunks, after = [], set(), set()
        for text in texts:
            plan: list = []
            for part in self.split_added(text) if self.split_added and any(x in text for x in self.added) else [text]:
                if part in self.added:
                    plan.append((([], []), self.added[part]))
                elif self.risky(part):  # cut where white space begins: no piece reaches across
                    plan.append(((self.segments(part), []), None))
                elif part:  # so does a single space between other characters
                    head, *rest = part.split(" ")
                    plan.append((([head] if head else [], rest), None))
            for (segments, rest), _ in plan:
                chunks.update(segments)
                after.update(rest)
            plans.append(plan)
        self._learn(self.chunks, chunks.difference(self.chunks), "")
        self._learn(self.after, after.difference(self.after), " ")
        of_chunk, of_after = self.chunks.__getitem__, self.after.__getitem__
        for plan in plans:
            found: list[bytes] = []
            for (segments, rest), special in plan:
                found.extend(map(of_chunk, segments))
                found.extend(map(of_after, rest))
                if special is not None:
                    found.append(special.to_bytes(4, sys.byteorder))
            yield np.frombuffer(b"".join(found), np.int32).tolist()
        for known, used in ((self.chunks, chunks), (self.after, after), (self.words, self.words)):
            for x in [x for x in used if len(x) > LONG]:
                self.kept -= ENTRY + len(x) + len(known.pop(x))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def groups(column: pa.Array) -> Iterator[list[str]]:
    """The texts in order, in lists of about TEXTS characters; null counts as empty."""
    texts, n = [], 0
    for x in column:
        texts.append(x.as_py() or "")
        n += len(texts[-1])
        if n >= TEXTS:
            yield texts
            texts, n = [], 0
    if texts:
        yield texts


#: What can be asked for, with its type: the ids, their number, the text decoded from them, and digests.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_SPARK = {"long": T.LongType(), "string": T.StringType(), "array<int>": T.ArrayType(T.IntegerType())}
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def encode_decode(docs: DataFrame, spec: str, outputs: Sequence[str] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, *outputs) for each row: the text's ids, and the text decoded from these ids.

    spec is the content of a tokenizers file with byte-level BPE; the driver reads it and sends it to the executors,
    as its size is fixed. A special token in a text gets its id. A null text counts as empty and has no ids;
    repeated rows are coded alike; null ids of documents stay null; other columns are left out. One pass, no shuffle;
    each document is coded whole by the worker that reads it, some at a time. A file that is not byte-level BPE with
    the usual split is refused with a ValueError. A word, which is a run without white space, takes some 60 bytes of a
    worker's memory for each of its own bytes while it is merged; it is never cut.
    """
    supported(json.loads(spec))
    sent = python_ready(docs).sparkContext.broadcast(spec)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(x, _SPARK[OUTPUTS[x]]) for x in outputs)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            coder = Coder(sent.value)
            names, sha = coder.names.__getitem__, hashlib.sha256
            for batch in slices(batches):
                cols: dict[str, list] = {x: [] for x in outputs}
                for ids in chain.from_iterable(map(coder.encode, groups(batch.column(1)))):
                    decoded = coder.decode(ids) if "decoded" in cols or "decoded_sha256" in cols else ""
                    for name, col in cols.items():
                        if name == "n_tokens":
                            col.append(len(ids))
                        elif name == "ids":
                            col.append(np.array(ids, np.int32))
                        elif name == "decoded":
                            col.append(decoded)
                        elif name == "ids_sha256":
                            col.append(sha(",".join(map(names, ids)).encode()).hexdigest())
                        else:
                            col.append(sha(decoded.encode()).hexdigest())
                arrays = [pa.array(v, _ARROW[OUTPUTS[k]]) for k, v in cols.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *outputs])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(code, schema)
