"""SentencePiece BPE encoding by backtracking, and decoding.

The encoder of merge-type vocabularies here doesn't run the merges over the text. For each position an Aho-Corasick
automaton gives the pieces that start there. The encoder takes the longest, provided that it may follow the previous
token: a pair of tokens may stand side by side if merging their joined characters gives just this pair. If no piece
fits, the position is marked in a bit field of failed positions and the previous token gives way to its next shorter
one. A sequence in which every neighbouring pair may stand side by side is the result of the merges over the whole
text, and there is only one, so what is found is exact.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import read_table, small_batches

SPACE = "▁"
#: Entries that a worker remembers for segments and for token pairs; a full memory is emptied, so it stays bounded.
MEMORY = 150_000
#: Longer segments are encoded but not remembered.
REMEMBERED = 48


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: pieces with id and score, the ids of bytes, and the dummy prefix."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unk_id: int
    dummy_prefix: bool


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece BPE model with identity normalisation; others are refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only BPE models with identity normalisation are supported")
    pieces = tuple((p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1)
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
        raise ValueError("pieces that cross white space are not supported")
    by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
    unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
    return Vocabulary(pieces, tuple(by_byte.get(b, unk) for b in range(256)), unk, norm.add_dummy_prefix)


class Memory(dict):
    """A dictionary that makes missing entries; when full it starts anew and asks its predecessor once more."""

    def __init__(self, make, size: int = MEMORY) -> None:
        super().__init__()
        self.make, self.size, self.before = make, size, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.vocabulary = vocabulary
        self.score = {p: s for p, _, s in vocabulary.pieces}
        self.id = {p: i for p, i, _ in vocabulary.pieces}
        self.text = {i: p for p, i, _ in vocabulary.pieces}
        self.byte = {i: b for b, i in enumerate(vocabulary.byte_ids)}
        self.automaton = ahocorasick.Automaton()
        for p, _, _ in vocabulary.pieces:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        #: No piece is longer, so the search for one that starts here looks no further.
        self.reach = max(map(len, self.score), default=1)
        #: The next shorter piece that is a prefix, for what longest matches leave out.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.id), p[0]) if len(p) > 1 else None for p in self.id}
        self.fits = Memory(self.side_by_side)
        self.merges = Memory(self.merge)
        self.done = Memory(self.do_segment)
        # Line feeds are cut off too, where no piece holds one: they never merge.
        apart = "" if any("\n" in p for p, _, _ in vocabulary.pieces) else "\n"
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + ("|\n" if apart else "")).findall

    def merge(self, s: str) -> tuple[tuple[float, ...], tuple[str, ...], tuple[str, ...], bool]:
        """Merge the characters of a token: best score first, leftmost on ties.

        Returns the score of each merge, the first and the last part before each merge and after all of them, and
        whether one part is left.
        """
        parts, score = list(s), self.score
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return (*scores, float("-inf")), tuple(firsts), tuple(lasts), len(parts) == 1

    def side_by_side(self, pair: tuple[str, str]) -> bool:
        """Whether merging the joined characters of two tokens gives the two tokens.

        The merges inside either token are those of the token alone, in order of their scores, until one crosses from
        one into the other; so the two lists are run through together, looking for one that crosses.
        """
        (sa, _, last, one_a), (sb, first, _, one_b) = self.merges[pair[0]], self.merges[pair[1]]
        if not (one_a and one_b):
            return False
        i, j, na, nb, score = 0, 0, len(sa) - 1, len(sb) - 1, self.score
        while True:
            a, b = sa[i], sb[j]
            x = score.get(last[i] + first[j])
            if x is not None and x > a and x >= b:
                return False
            if i == na and j == nb:
                return True
            if j == nb or (i < na and a >= b):
                i += 1
            else:
                j += 1

    def longest(self, s: str, at: int) -> str:
        """The longest piece that starts here, or else the character."""
        ahead = s[at : at + self.reach]  # searching in the whole string would cost its length at every call
        for end, length in self.automaton.iter_long(ahead):
            return ahead[: end + 1] if end + 1 == length else s[at]
        return s[at]

    def pieces_of(self, s: str) -> list[str]:
        """The pieces of one segment, by backtracking; characters without a piece stand alone."""
        if s in self.id and self.merges[s][3]:
            return [s]
        n, at, tokens, failed = len(s), 0, [], bytearray(len(s) + 1)
        fits, shorter, longest = self.fits, self.shorter, self.longest
        token = longest(s, 0)
        while True:
            while token is not None:
                if not failed[at + len(token)] and (fits[tokens[-1], token] if tokens else self.merges[token][3]):
                    break
                token = shorter.get(token)
            if token is None:
                failed[at] = 1
                last = tokens.pop()
                at -= len(last)
                token = shorter.get(last)
                continue
            tokens.append(token)
            at += len(token)
            if at == n:
                return tokens
            token = longest(s, at)

    def encode_segment(self, s: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces_of(s):
            i = self.id.get(p)
            if i is None:
                out.extend(self.vocabulary.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out

    def surface(self, ids: list[int]) -> str:
        """Pieces and bytes put together, spaces still escaped; bytes that aren't UTF-8 become U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text.get(i, ""))
        return "".join(out) + raw.decode("utf-8", "replace")

    def segments(self, text: str) -> list[str]:
        """The text with escaped spaces, cut where no piece can cross."""
        if not text:
            return []
        return self.cut((SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.encode_segment(s)]

    def decode(self, ids: list[int]) -> str:
        out = self.surface(ids)
        return out.removeprefix(SPACE).replace(SPACE, " ") if self.vocabulary.dummy_prefix else out.replace(SPACE, " ")

    def do_segment(self, s: str) -> tuple[str, str]:
        ids = self.encode_segment(s)
        return ",".join(map(str, ids)), self.surface(ids)

    def both(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the text decoded from them; a segment met before is remembered."""
        segs = self.segments(text)
        if not segs:
            return "", 0, ""
        if max(map(len, segs)) > REMEMBERED:
            ids, back = zip(*(self.do_segment(s) if len(s) > REMEMBERED else self.done[s] for s in segs), strict=True)
        else:
            ids, back = zip(*map(self.done.__getitem__, segs), strict=True)
        joined, plain = ",".join(ids), "".join(back)
        if self.vocabulary.dummy_prefix:
            plain = plain.removeprefix(SPACE)
        return joined, joined.count(",") + 1, plain.replace(SPACE, " ")


@functools.lru_cache(maxsize=2)
def codec_of(vocabulary: Vocabulary) -> Codec:
    """A worker that runs several tasks keeps its codec and what it remembers."""
    return Codec(vocabulary)


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, digests: bool = False) -> DataFrame:
    """Every row of ``docs`` as (doc_id, ids array<int>, n_tokens, decoded), or with ``digests`` as
    (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null text counts as empty; an empty text has no token. Each partition streams through one worker in short
    batches, so memory follows a batch and the bounded memories of the codec. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for b in batches:
            done = [codec.both(t or "") for t in b.column(1).to_pylist()]
            n = pa.array([x[1] for x in done], pa.int64())
            if digests:
                cols = [b.column(0), n, pa.array([sha(x[0]) for x in done], pa.string()), pa.array([sha(x[2]) for x in done], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = pa.array([[int(i) for i in x[0].split(",")] if x[0] else [] for x in done], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), ids, n, pa.array([x[2] for x in done], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, n_tokens long, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Contract query: digests of the ids and of the decoded text of every document."""
    return encode_decode(read_table(spark, sf_dir, "documents"), load_vocabulary(model or default_model()), digests=True)
