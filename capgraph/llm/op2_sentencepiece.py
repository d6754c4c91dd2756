"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces of a SentencePiece file and their scores span a lattice over a
text; its encoding is the path of greatest total score.  That is a product of
matrices over (max, +), so it can be taken in parts:

1. a giant text is split into chunks of ``chunk_chars`` characters at any
   place.  A state at a chunk's edge is how far the last token reaches over
   it (less than the longest piece);
2. each chunk by itself gives its transfer matrix: the best score from every
   state at its start to every state at its end;
3. the matrices are combined associatively to the best scores of the states
   at every edge;
4. knowing these, each chunk by itself traces back, for every state at its
   end, its tokens and the state at its start that they come from;
5. the chunks' states are chained from the end and the tokens joined.

No piece of such a file reaches over the start of a word (checked when the
file is read; else whole chunks take the matrix path), so all paths meet
there: inside a chunk only the torn first and last words need matrices, and
the words between come from a memo.  Scores are summed as 64-bit integers
(scaled, if a file's scores aren't whole), so no rounding decides a tie; ties
go to the longer last piece, as in the library.

The best path is what a *unigram* file stands for.  For a file of merge ranks
such as ``piece_bpe_32k.model`` merging isn't a problem of best paths; its
pieces and scores are read as a unigram lattice here, and its ids are those
that the library's lattice ranks first for the same pieces with the model type
unigram.  They decode to the same text as the merged ids, which the library's
own ``encode`` of that file gives (see ``op5`` for counts of those).

Defined cases: null and empty texts have no tokens; repeated rows are encoded
each by itself; unknown characters become byte pieces; decoding gives the
text back exactly, except that the mark U+2581 in a text is read as a space,
as in the library; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import common
from .tokenizer import Memo, default_path

FILE = "piece_bpe_32k.model"
CHUNK_CHARS = 16_384
MARK = "▁"
LOW = -(1 << 62)
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: The library's penalty of an unknown character below the least score (fixed value).
UNKNOWN_PENALTY = 10.0
#: Words of fewer characters are encoded many at a time, from texts of so many bytes.
LONG_WORD = 64
#: Words remembered, in each of two generations.
MEMO_WORDS = 100_000
PASS_BYTES = 1 << 18


class Pieces:
    """The lattice of a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in normal}
        self.scale = 1 if all(float(s).is_integer() for s in scores.values()) else 1 << 20
        self.table = {pieces[i]: (round(scores[i] * self.scale), i) for i in normal}
        self.unknown = round((min(scores.values()) - UNKNOWN_PENALTY) * self.scale)
        self.longest = max(map(len, self.table))
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        # whether all paths meet where a word starts
        self.meets = not any(MARK in p.lstrip(MARK) for p in self.table)
        self.score_of = np.zeros(n, np.int64)
        for score, i in self.table.values():
            self.score_of[i] = score
        self.begins = {q[:k] for q in self.table for k in range(1, len(q))}
        self.known = {p for p in self.table if len(p) == 1}
        self.memo = Memo(self._word, MEMO_WORDS)
        self.trie = Trie({p: i for p, (_, i) in self.table.items()})

    def edges(self, text: str, at: int):
        """(length, score, id) of the pieces at a place, shorter ones first; an
        unknown character has the id -1."""
        table = self.table
        for size in range(1, min(self.longest, len(text) - at) + 1):
            part = text[at:at + size]
            hit = table.get(part)
            if hit is not None:
                yield size, *hit
            if part not in self.begins:
                break
        if text[at] not in table:
            yield 1, self.unknown, -1

    def ids(self, text: str, token: tuple[int, int, int]) -> list[int]:
        start, size, piece = token
        if piece >= 0:
            return [piece]
        spelled = text[start:start + size].encode("utf-8", "replace")
        return [self.bytes[b] for b in spelled] if len(self.bytes) == 256 else [self.unk]

    def trace(self, text: str, stop: int, entry: list[int]):
        """Best scores at all places and the tokens that reach them.  Tokens
        start before ``stop``; ``entry[s]`` is the score of starting at s."""
        n = len(text)
        best, back = [LOW] * (n + 1), [None] * (n + 1)
        for s, score in enumerate(entry):
            if s <= n:
                best[s] = score
        for at in range(min(stop, n)):
            here = best[at]
            if here == LOW:
                continue
            for size, score, piece in self.edges(text, at):
                if here + score > best[at + size]:
                    best[at + size], back[at + size] = here + score, (at, size, piece)
        return best, back

    def walk(self, text: str, back, end: int) -> tuple[int, list[int]]:
        """Where the path to ``end`` comes in, and its ids."""
        found = []
        while back[end] is not None:
            found.append(self.ids(text, back[end]))
            end = back[end][0]
        return end, [i for part in reversed(found) for i in part]

    def _best(self, segment: str) -> bytes:
        if not self.known.issuperset(segment):
            _, back = self.trace(segment, len(segment), [0])
            return np.array(self.walk(segment, back, len(segment))[1], "<u4").tobytes()
        # ``trace`` without its cases: every place can be reached
        table, begins, n = self.table, self.begins, len(segment)
        best, back = [0] + [LOW] * n, [(0, 0)] * (n + 1)
        for at in range(n):
            here, end = best[at], at + 1
            while end <= n:
                part = segment[at:end]
                hit = table.get(part)
                if hit is not None and here + hit[0] > best[end]:
                    best[end], back[end] = here + hit[0], (at, hit[1])
                if part not in begins:
                    break
                end += 1
        ids = []
        while n:
            n, piece = back[n]
            ids.append(piece)
        return struct.pack(f"<{len(ids)}I", *reversed(ids))

    def _word(self, word: str) -> bytes:
        return self._best(MARK + word)

    def learn(self, words) -> None:
        """Give the memo the words that it doesn't hold, encoded in one pass;
        long ones wait for ``_best``."""
        memo = self.memo
        new = [w for w in set(words) if w not in memo and w not in memo.old and len(w) < LONG_WORD]
        if not new:
            return
        ids, counts = self.trie.best([MARK + w for w in new], self.score_of, self.unknown, self._spelled)
        ids, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        memo.take(zip(new, (ids[a:b] for a, b in zip([0, *ends], ends))), len(new))

    def _spelled(self, character: str) -> list[int]:
        return self.ids(character, (0, 1, -1))

    def plain(self, text: str) -> bytes:
        """The ids of a normalised text, as little-endian 32-bit numbers."""
        if not self.meets:
            return self._best(text) if text else b""
        get = self.memo.__getitem__
        if text[:1] == MARK and MARK + MARK not in text:
            return b"".join(map(get, text[1:].split(MARK)))
        return b"".join(get(s[1:]) if s[0] == MARK and s[1:2] != MARK else self._best(s) for s in SEGMENT.findall(text))

    def ids_of(self, body: bytes) -> bytes:
        """The ids of a UTF-8 text."""
        text = body.decode("utf-8", "replace")
        if text and self.meets and text[0] != " " and "  " not in text and MARK not in text:
            return b"".join(map(self.memo.__getitem__, text.split(" ")))
        return self.plain(normalised(body))


def spellings(path: str) -> list[bytes]:
    """The bytes that each id of a file stands for."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = lambda i, p: bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode()
    return [text(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())]


class Trie:
    """The pieces as states and transitions in arrays, and the best paths of
    many words at once."""

    def __init__(self, pieces: dict[str, int]):
        states, keys, to, piece = {"": 0}, [], [], [-1]
        for p, i in sorted(pieces.items()):
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    piece.append(-1)
                    keys.append(states[p[:k - 1]] << 21 | ord(p[k - 1]))
                    to.append(states[p[:k]])
            piece[states[p]] = i
        self.piece = np.array(piece, np.int64)
        # open addressing; a key is a state and a character, so a hit is exact
        size = 4 << len(keys).bit_length()
        self.bits, self.keys, self.to = size.bit_length() - 1, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        left, value = np.array(keys, np.int64), np.array(to, np.int64)
        place = self._place(left)
        while len(left):
            free = self.keys[place] < 0
            taken, first = np.unique(place[free], return_index=True)
            at = np.flatnonzero(free)[first]
            self.keys[taken], self.to[taken] = left[at], value[at]
            rest = np.ones(len(left), bool)
            rest[at] = False
            left, value, place = left[rest], value[rest], (place[rest] + 1) & size - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        key = state << 21 | character
        place, out = self._place(key), np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            held = self.keys[place]
            hit = held == key[open_]
            out[open_[hit]] = self.to[place[hit]]
            on = ~hit & (held >= 0)
            open_, place = open_[on], (place[on] + 1) & len(self.keys) - 1
        return out

    def best(self, words: list[str], score_of: np.ndarray, unknown: int, spelled) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best path of each word, one after the other, and how
        many each has.  Of equal paths the one with the longer last piece stays.
        ``unknown``: the score of a character that is no piece; ``spelled`` gives
        its ids."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words])
        begin = np.cumsum(length) - length
        offset = np.arange(len(points)) - np.repeat(begin, length)
        end = np.repeat(begin + length, length)
        # edges of the lattice: from a character, so many characters, a piece
        at, state, found = np.arange(len(points)), np.zeros(len(points), np.int64), []
        single = self.step(state, points)
        odd = np.flatnonzero((single < 0) | (self.piece[single] < 0))
        found.append((odd, np.ones(len(odd), np.int64), np.full(len(odd), -1)))
        for size in range(1, int(length.max()) + 1):
            inside = at + size <= end[at]
            at, state = at[inside], state[inside]
            state = self.step(state, points[at + size - 1])
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                break
            whole = self.piece[state] >= 0
            found.append((at[whole], np.full(int(whole.sum()), size), self.piece[state[whole]]))
        start, size, piece = (np.concatenate(x) for x in zip(*found))
        # words side by side: of one offset and size, no two edges reach the same place
        step = offset[start] * (int(size.max()) + 1) + size
        order = np.argsort(step, kind="stable")
        start, size, piece, step = start[order], size[order], piece[order], step[order]
        cuts = np.flatnonzero(np.append(True, step[1:] != step[:-1])).tolist() + [len(step)]
        place = start + np.repeat(np.arange(len(words)), length)[start]  # a word has a place more than characters
        n = len(points) + len(words)
        best, back, by = np.full(n, LOW), np.zeros(n, np.int64), np.zeros(n, np.int64)
        first = begin + np.arange(len(words))
        best[first] = 0
        score = np.where(piece < 0, unknown, score_of[piece])
        for a, b in zip(cuts, cuts[1:]):
            here, there = place[a:b], place[a:b] + size[a]
            total = best[here] + score[a:b]
            better = total > best[there]
            there = there[better]
            best[there], back[there], by[there] = total[better], here[better], piece[a:b][better]
        word, place, steps = np.arange(len(words)), first + length, []
        while len(word):
            steps.append((word, by[place], back[place]))
            place = back[place]
            on = place != first[word]
            word, place = word[on], place[on]
        counts = np.bincount(np.concatenate([w for w, *_ in steps]), minlength=len(words))
        ends = np.cumsum(counts)
        ids, owner, begun = (np.zeros(int(counts.sum()), np.int64) for _ in range(3))
        for k, (word, piece, place) in enumerate(steps):
            at = ends[word] - 1 - k
            ids[at], owner[at], begun[at] = piece, word, place - word
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            character = points[begun[odd]]
            own = {c: spelled(chr(c)) for c in np.unique(character).tolist()}
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(own[c]) for c in character.tolist()]
            at = (np.cumsum(size) - size)[odd]
            ids, owner = np.repeat(ids, size), np.repeat(owner, size)
            for c, spelling in own.items():
                for k, i in enumerate(spelling):
                    ids[at[character == c] + k] = i
            counts = np.bincount(owner, minlength=len(words))
        return ids, counts


_LOADED = common.cache("sentencepiece")


def load(path: str) -> Pieces:
    common.begin("sentencepiece")
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def normalised(body: bytes) -> str:
    """The text with the mark for spaces and before its start."""
    text = body.decode("utf-8", "replace")
    return MARK + text.replace(" ", MARK) if text else ""


# -- one chunk ---------------------------------------------------------------

class Chunk:
    """``text``: the chunk and the start of the next one, as far as a token
    can reach; tokens start in the first ``size`` characters."""

    def __init__(self, pieces: Pieces, text: str, size: int):
        self.p, self.text, self.size, self.states = pieces, text, size, pieces.longest
        # where all paths meet for sure: the first and last start of a word that no incoming token covers
        places = [m.start() for m in re.finditer(f"(?<!{MARK}){MARK}", text[:size])] if pieces.meets else []
        places = [x for x in places if x >= self.states]
        self.first, self.last = (places[0], places[-1]) if places else (None, None)

    def matrix(self) -> np.ndarray:
        """Best score from each state at the start to each state at the end, up
        to a constant."""
        n = self.states
        if self.first is None:
            return np.array([self._ends(self._scores(self.text, self.size, s)) for s in range(n)], np.int64)
        head = np.array([self._scores(self.text[:self.first], self.first, s)[self.first] for s in range(n)], np.int64)
        # the words between add the same to all entries, which decides nothing, so they are left out
        tail = self.text[self.last:]
        best, _ = self.p.trace(tail, self.size - self.last, [0])
        tail = np.array(self._ends(best, self.size - self.last), np.int64)
        return plus(head[:, None], tail[None, :])

    def _scores(self, text: str, stop: int, state: int) -> list[int]:
        return self.p.trace(text, stop, [LOW] * state + [0])[0]

    def _ends(self, best: list[int], size: int | None = None) -> list[int]:
        size = self.size if size is None else size
        return [best[size + s] if size + s < len(best) else LOW for s in range(self.states)]

    def variants(self, entry: list[int]) -> tuple[list[int], bytes, list[bytes]]:
        """For each state at the end, the state at the start that its best path
        comes from; the ids that all these paths begin with, and the rest of
        each path's ids."""
        pack = lambda ids: np.array(ids, "<u4").tobytes()
        text, start, head, first = self.text, None, b"", 0
        if self.first is not None:
            _, back = self.p.trace(text[:self.first], self.first, entry)
            start, ids = self.p.walk(text, back, self.first)
            head = pack(ids) + self.p.plain(text[self.first:self.last])
            text, entry, first = text[self.last:], [0], self.last
        best, back = self.p.trace(text, self.size - first, entry)
        starts, tails = [], []
        for end in range(self.size - first, self.size - first + self.states):
            came, ids = self.p.walk(text, back, end) if end < len(best) and best[end] != LOW else (-1, [])
            starts.append(came if start is None or came < 0 else start)
            tails.append(pack(ids))
        return starts, head, tails


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b where LOW is minus infinity."""
    return np.where((a <= LOW // 2) | (b <= LOW // 2), LOW, a + b)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of two matrices."""
    return plus(a[:, :, None], b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by an associative scan in
    log2(n) doubling steps."""
    out, step = list(matrices), 1
    while step < len(out):
        out = out[:step] + [product(out[i - step], out[i]) for i in range(step, len(out))]
        step *= 2
    return out


# -- on Spark ------------------------------------------------------------------

CHUNKS = "doc_id bigint, row bigint, chunk int, size int, text string"
ENCODED = "doc_id bigint, ids binary"


def chunked(docs: DataFrame, chunk_chars: int, reach: int) -> DataFrame:
    """Texts in chunks, one row each; ``row`` tells the input's rows apart."""

    def run(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for doc_id, row, body in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("body")):
                text = normalised(body.as_py())
                for k, at in enumerate(range(0, len(text), chunk_chars)):
                    for column, x in zip(out, (doc_id, row, k, min(chunk_chars, len(text) - at),
                                               text[at:at + chunk_chars + reach])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                ["doc_id", "row", "chunk", "size", "text"])

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, CHUNKS)


def encode(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row.  Texts of
    more than ``chunk_chars`` bytes are the giant ones."""
    texts = common.id_text(docs, id_col, text_col)
    giant = F.octet_length("body") > chunk_chars

    def whole(batches):
        p = load(path)
        for b in batches:
            ids = []
            for bodies in common.runs_of((x.as_py() for x in b.column("body")), PASS_BYTES):
                p.learn(b" ".join(bodies).decode("utf-8", "replace").split(" "))
                ids += map(p.ids_of, bodies)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts.where(~giant).mapInArrow(whole, ENCODED).unionByName(scanned(texts.where(giant), path, chunk_chars))


def scanned(texts: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """The encoding of giant texts (doc_id, body) by the parallel scan."""
    states = load(path).longest
    chunks = common.written(chunked(texts, chunk_chars, states - 1).repartition("row", "chunk"))

    def transfer(batches):
        p = load(path)
        for b in batches:
            ms = [Chunk(p, t, n).matrix().tobytes() for t, n in zip(b.column("text").to_pylist(), b.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), pa.array(ms, pa.binary())], ["row", "chunk", "matrix"])

    def combine(key, table):
        table = table.sort_by("chunk")
        ms = [np.frombuffer(m, np.int64).reshape(states, states) for m in table.column("matrix").to_pylist()]
        entries = [[0] + [LOW] * (states - 1)] + [m[0].tolist() for m in scan(ms)[:-1]]
        return pa.table({"row": table.column("row"), "chunk": table.column("chunk"),
                         "entry": pa.array(entries, pa.list_(pa.int64()))})

    # a matrix is 2 KB for a chunk of 16,384 characters: a group is an eighth of one text
    entries = common.written(chunks.mapInArrow(transfer, "row bigint, chunk int, matrix binary")
                             .groupBy("row").applyInArrow(combine, "row bigint, chunk int, entry array<bigint>"))

    def back(batches):
        p = load(path)
        for b in batches:
            found = []
            for i in range(0, b.num_rows, 16):
                part = b.slice(i, 16)
                texts = part.column("text").to_pylist()
                p.learn(MARK.join(texts).split(MARK))
                found += [Chunk(p, t, n).variants(e) for t, n, e in zip(
                    texts, part.column("size").to_pylist(), part.column("entry").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), b.column("chunk"), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                 pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.list_(pa.binary()))],
                ["doc_id", "row", "chunk", "starts", "head", "tails"])

    def chain(key, table):
        table = table.sort_by("chunk")
        state, parts = 0, []
        for r in reversed(table.select(["starts", "head", "tails"]).to_pylist()):
            parts.append(r["head"] + r["tails"][state])
            state = r["starts"][state]
        return pa.table({"doc_id": table.column("doc_id")[:1], "ids": pa.array([b"".join(reversed(parts))], pa.binary())})

    return (chunks.join(entries, ["row", "chunk"]).select("doc_id", "row", "chunk", "text", "size", "entry")
            .mapInArrow(back, "doc_id bigint, row bigint, chunk int, starts array<int>, head binary, tails array<binary>")
            .groupBy("row").applyInArrow(chain, ENCODED))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with body, the UTF-8 text that the ids stand for."""

    def run(batches):
        common.begin("sentencepiece")
        words = spellings(path)
        lengths = np.array([len(w) for w in words])
        starts, spelled = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8)

        def text(ids: bytes) -> bytes:
            ids = np.frombuffer(ids, "<u4")
            size = lengths[ids]
            ends = np.cumsum(size)
            if not len(ids):
                return b""
            # a byte's place: its piece's start, and how far it is from the piece's first byte
            return spelled[np.repeat(starts[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()

        for b in batches:
            out = []
            for ids in b.column("ids"):
                body = text(ids.as_py())
                out.append(body[1:] if body[:1] == b" " else body)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "body"])

    return encoded.mapInArrow(run, common.with_fields(encoded.schema, body=BinaryType()))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the little-endian 32-bit ids), and
    decoded_bytes, decoded_sha256 of the text decoded again, of every document."""
    path = default_path(FILE)
    done = decode(encode(common.table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.octet_length("body").cast("bigint").alias("decoded_bytes"), F.sha2("body", 256).alias("decoded_sha256"))
