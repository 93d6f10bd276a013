"""Operator 2: SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into three transducers:

* the normaliser (`Normaliser`): a byte trie with a replacement at each final state, longest match first (the character
  map of the model), then the rules of white space (dummy prefix, extra spaces, space to U+2581);
* the pieces (`Transducer.trie`): a character trie; each final state gives out a piece. Under a unigram model its
  weight is minus the score. Under a model of merges the weight depends on the piece before it: 0 if the merges, applied to
  the characters of both alone, give just these two, infinite otherwise, as a sequence is what the merges make of
  a text exactly if all its neighbours are such pairs;
* the byte fallback: a character that no piece spells alone has an arc to its UTF-8 byte pieces (or the unknown piece), which
  costs PENALTY more than the worst piece.

They are composed with each input lazily: states are (position, last piece), and walking the trie from a state gives its
outgoing arcs only (`Transducer.arcs`). `shortest` takes the path of least weight in the tropical semiring (min, +): scores are
relaxed from left to right with back pointers (`_relaxed`), among equal weights the arc with the earliest start wins; where all
weights are 0 or infinite, the best-first search ends with the first path it completes, states of the longest piece first, and
comes back to no dead state (`_searched`). Ids equal those of the sentencepiece library, but for its rounding of equal scores.

Texts are cut where no arc spans (before a space mark, around user-defined pieces of merges), and each worker keeps the
paths of its recent chunks in two generations of bounded size.

Result: struct ``ids`` (array of int), ``n_bytes`` (byte-fallback pieces). Decoding maps ids to text.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; control ids decode to
nothing; U+2581 in a text decodes as a space (as in the library); any other text comes back exactly under an identity
normaliser, and as its normal form under another; repeated rows have equal ids. Models of words or characters, with white space as
a suffix or with unused pieces under merges are refused when compiled.
"""

from __future__ import annotations

import re
from array import array
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .text import free, table, utf8

SPACE = "▁"
#: Cost of an unknown character beyond the lowest score, and the bonus of user-defined pieces (fixed values of the format).
PENALTY, BONUS = 10.0, 0.1
#: Chunks and pairs in one of the two generations kept by a worker, and characters of the longest chunk kept.
KEPT_CHUNKS, KEPT_PAIRS, KEPT_LENGTH = 250_000, 400_000, 40
MODEL = "piece_bpe_32k.model"


def default_model() -> str:
    """Path of the public model of the image; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Memo(dict):
    """Values of `make`, kept in two generations of `most`: what was not asked for while one filled is forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > KEPT_LENGTH:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Normaliser:
    """Character map and white-space rules of a model."""

    def __init__(self, spec, user_defined: list[str]):
        self.dummy, self.extra = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else " "
        self.own = re.compile("|".join(map(re.escape, sorted(user_defined, key=len, reverse=True)))) if user_defined else None
        blob = spec.precompiled_charsmap
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = array("I", np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.uint32).tobytes())
        self.targets = blob[4 + size :]

    def _longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest path of the trie at a place. A unit holds label, leaf mark and offset."""
        units = self.units
        state, found = 0, None
        unit = units[0]
        state ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            state ^= text[k]
            if state >= len(units):
                break
            unit = units[state]
            if unit & 0x800000FF != text[k]:
                break
            state ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = k + 1 - at, units[state] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.targets[found[1] : self.targets.index(b"\0", found[1])]

    def _mapped(self, text: str) -> str:
        data, out, at = text.encode(), [], 0
        while at < len(data):
            hit = self._longest(data, at)
            if hit is None:
                lead = data[at]
                step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = step, data[at : at + step]
            out.append(hit[1])
            at += hit[0]
        return b"".join(out).decode()

    def apply(self, text: str) -> str:
        if self.units:
            if self.own is None:
                text = self._mapped(text)
            else:  # user-defined pieces are taken as they are
                parts, at = [], 0
                for m in self.own.finditer(text):
                    parts += [self._mapped(text[at : m.start()]), m[0]]
                    at = m.end()
                text = "".join([*parts, self._mapped(text[at:])])
        if self.extra:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", self.space)


class Transducer:
    """A compiled model, sent to the executors once by broadcast."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds, kind = pb.ModelProto.SentencePiece, proto.trainer_spec.model_type
        self.merges = kind == pb.TrainerSpec.BPE
        unused = any(p.type == kinds.UNUSED for p in proto.pieces)
        if kind not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM) or proto.trainer_spec.treat_whitespace_as_suffix or (self.merges and unused):
            raise ValueError("only unigram models and models of merges without unused pieces and without white space as a suffix are compiled")
        self.size = len(proto.pieces)
        self.names = [p.piece for p in proto.pieces]
        self.fixed = frozenset(i for i, p in enumerate(proto.pieces) if p.type == kinds.USER_DEFINED)
        self.normaliser = Normaliser(proto.normalizer_spec, [self.names[i] for i in self.fixed])
        scores = [p.score for p in proto.pieces if p.type == kinds.NORMAL]
        best, worst = max(0.0, *scores), min(0.0, *scores)
        self.scores = [len(p.piece) * best - BONUS if p.type == kinds.USER_DEFINED else p.score for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.costs = [*(-x for x in self.scores), PENALTY - worst]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.is_byte = np.zeros(self.size, dtype=bool)
        self.is_byte[list(self.bytes.values())] = True
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.trie = self._grown(sorted(self.ids.items()), 0)
        surface = {kinds.NORMAL: lambda p: p.piece.replace(SPACE, " ").encode(), kinds.USER_DEFINED: lambda p: p.piece.replace(SPACE, " ").encode(), kinds.UNUSED: lambda p: p.piece.replace(SPACE, " ").encode(), kinds.BYTE: lambda p: bytes([int(p.piece[3:5], 16)]), kinds.UNKNOWN: lambda p: (proto.trainer_spec.unk_surface or " ⁇ ").encode()}
        self.surface = [surface.get(p.type, lambda p: b"")(p) for p in proto.pieces]
        # no arc spans such a place, so that a text may be cut there: before a space mark after something else, around \n
        space = self.normaliser.space
        inside = any(space in p.lstrip(space) for p in self.ids)
        line = any("\n" in p for p in self.ids)
        self.cut = re.compile(".+" if inside else f"{space}+[^{space}]*|[^{space}]+" if line else f"{space}+[^{space}\n]*|[^{space}\n]+|\n", re.DOTALL)
        self.whole = re.compile("(" + "|".join(map(re.escape, sorted((self.names[i] for i in self.fixed), key=len, reverse=True))) + ")") if self.merges and self.fixed else None
        self._forget()

    def _grown(self, pieces: list[tuple[str, int]], depth: int) -> dict:
        """The trie of sorted pieces from a depth on: character to (piece that ends here or -1, next characters)."""
        out = {}
        for ch, own in groupby(pieces, key=lambda p: p[0][depth]):
            group = list(own)
            ends = [i for piece, i in group if len(piece) == depth + 1]
            out[ch] = ends[0] if ends else -1, self._grown(group[len(ends) :], depth + 1)
        return out

    def _forget(self) -> None:
        self.chunks, self.weights = Memo(self.shortest, KEPT_CHUNKS), Memo(self._weight, KEPT_PAIRS)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("chunks", "weights")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored neighbours first, the left ones among equals."""
        parts = list(text)
        while True:
            best = at = None
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and k not in self.fixed and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _weight(self, arc: int) -> bool:
        """Whether the arc (last piece) * size + new piece has weight 0 under merges; `size` as the last piece stands for the start and for bytes."""
        last, new = divmod(arc, self.size)
        a, b = "" if last == self.size else self.names[last], self.names[new]
        if new in self.fixed:  # a chunk of its own
            return True
        return self._merged(a + b) == ([a, b] if a else [b])

    def arcs(self, chunk: str, i: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs from position i, short ones first; the piece `size` is a character spelt in bytes."""
        out, nodes, j = [], self.trie, i
        for ch in chunk[i:]:
            found = nodes.get(ch)
            if found is None:
                break
            j += 1
            new, nodes = found
            if new >= 0:
                out.append((j, new))
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, self.size))
        return out

    def _searched(self, chunk: str) -> list[tuple[int, int]]:
        """(end, piece) of the path of weight 0. One path of finite weight at most reaches a position, so a position left once is dead."""
        n, size, weights, trie = len(chunk), self.size, self.weights, self.trie
        ends, pieces, left, dead = [0], [size], [], set()
        i, last = 0, size * size
        while i < n:
            ways, nodes, j = [], trie, i  # ends and pieces of the arcs, as in arcs(), written out for speed
            for ch in chunk[i:]:
                found = nodes.get(ch)
                if found is None:
                    break
                j += 1
                new, nodes = found
                if new >= 0:
                    ways += (j, new)
            if not ways or ways[0] > i + 1:
                ways[:0] = (i + 1, size)
            while True:
                if not ways:
                    dead.add(ends.pop())
                    pieces.pop()
                    ways, last = left.pop(), pieces[-1] * size
                    continue
                new, j = ways.pop(), ways.pop()
                if (new == size or weights[last + new]) and j not in dead:
                    break
            ends.append(j)
            pieces.append(new)
            left.append(ways)
            i, last = j, new * size
        return list(zip(ends[1:], pieces[1:], strict=True))

    def _relaxed(self, chunk: str) -> list[tuple[int, int]]:
        """(end, piece) of the path of least weight."""
        n, scores = len(chunk), self.costs
        cost, back = [float("inf")] * (n + 1), [(0, 0)] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here = cost[i]
            for j, new in self.arcs(chunk, i):
                total = here + scores[new]
                if total < cost[j]:
                    cost[j], back[j] = total, (i, new)
        path, e = [], n
        while e:
            path.append((e, back[e][1]))
            e = back[e][0]
        return path[::-1]

    def shortest(self, chunk: str) -> bytes:
        """Ids (int32) on the path of least weight through the composition with one chunk."""
        out: list[int] = []
        s, was = 0, -1
        for e, k in self._searched(chunk) if self.merges else self._relaxed(chunk):
            if k != self.size:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes.get(b, self.unknown) for b in chunk[s:e].encode("utf-8", "surrogatepass"))
            elif was != k:  # neighbouring unknown characters make one unknown piece
                out.append(self.unknown)
            s, was = e, k
        return np.array(out, dtype=np.int32).tobytes()

    def cuts(self, text: str) -> list[str]:
        """The chunks of a text after normalisation."""
        text = self.normaliser.apply(text)
        if self.whole is None:
            return self.cut.findall(text)
        return [c for i, part in enumerate(self.whole.split(text)) for c in ([part] if i % 2 else self.cut.findall(part))]

    def coded(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, self.cuts(text))), dtype=np.int32)

    def encode(self, text: str) -> list[int]:
        return self.coded(text).tolist()

    def spelt(self, ids: list[int]) -> bytes:
        """The text of ids as UTF-8, before invalid sequences are replaced."""
        text = b"".join(map(self.surface.__getitem__, ids))
        return text[1:] if (self.normaliser.dummy or self.normaliser.extra) and text[:1] == b" " else text

    def decode(self, ids: list[int]) -> str:
        return self.spelt(ids).decode("utf-8", "replace")


_CODE = pa.struct([("ids", pa.list_(pa.int32())), ("n_bytes", pa.int64())])
_CODE_TYPE = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("n_bytes", T.LongType())


def _shared(spark: SparkSession, model_path: str | None):
    with open(model_path or default_model(), "rb") as f:  # the driver reads it; executors get the compiled parts
        return spark.sparkContext.broadcast(Transducer(f.read()))


def _encoded(texts: list[bytes | None], t: Transducer) -> tuple[list[np.ndarray], pa.Array, pa.Array]:
    """The ids of texts, as arrays and as an Arrow list, and the numbers of byte pieces."""
    ids = [np.zeros(0, dtype=np.int32) if x is None else t.coded(x.decode()) for x in texts]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *ids])
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in texts], pa.bool_()))
    return ids, lists, pa.array([int(t.is_byte[x].sum()) for x in ids], pa.int64())


def encode(docs: DataFrame, text: str = "text", model_path: str | None = None, out: str = "code") -> DataFrame:
    """`docs` with the struct column `out` (ids, n_bytes)."""
    shared = _shared(docs.sparkSession, model_path)

    @F.arrow_udf(_CODE_TYPE)
    def encoded(column: pa.Array) -> pa.Array:
        _, lists, n = _encoded(utf8(column), shared.value)
        return pa.StructArray.from_arrays([lists, n], fields=list(_CODE))

    return docs.withColumn(out, encoded(F.col(text)))


def decode(coded: DataFrame, ids: str = "ids", model_path: str | None = None, out: str = "decoded") -> DataFrame:
    """`coded` with the text of its ids in the column `out`."""
    shared = _shared(coded.sparkSession, model_path)

    @F.arrow_udf(T.StringType())
    def decoded(column: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else shared.value.decode(x.as_py()) for x in column], pa.string())

    return coded.withColumn(out, decoded(F.col(ids)))


def coded(docs: DataFrame, text: str = "text", model_path: str | None = None) -> DataFrame:
    """`docs` with the columns ids, n_tokens (0 for a null text), n_bytes (byte pieces) and round_trip (the ids decode to the text).

    Encoding and decoding are one pass, so that the text is read once and never kept beside its ids. Columns of
    `docs` with one of these four names are replaced.
    """
    shared = _shared(docs.sparkSession, model_path)
    fields = [*_CODE, pa.field("same", pa.bool_())]

    @F.arrow_udf(T.StructType([*_CODE_TYPE.fields]).add("same", T.BooleanType()))
    def both(column: pa.Array) -> pa.Array:
        t, texts = shared.value, utf8(column)
        ids, lists, n = _encoded(texts, t)
        same = [x is None or t.spelt(own.tolist()) == x for own, x in zip(ids, texts, strict=True)]
        return pa.StructArray.from_arrays([lists, n, pa.array(same, pa.bool_())], fields=fields)

    made = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens", "n_bytes", "round_trip")), both(F.col(text)).alias((name := free(docs, "code"))))
    return made.select("*", F.col(f"{name}.ids").alias("ids"), F.coalesce(F.size(f"{name}.ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col(f"{name}.n_bytes").alias("n_bytes"), F.col(f"{name}.same").alias("round_trip")).drop(name)


def op2(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives its text back."""
    return coded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
