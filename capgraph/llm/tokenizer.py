"""Token ids of whole texts from a public tokenizer file, inside Arrow tasks.

Two forms are used:

* ``WordTokenizer``: for a file whose normaliser and pre-tokeniser drop white
  space and whose pieces carry an end-of-word mark.  No token of such a file
  crosses white space, so a text's ids are the ids of its space-free chunks
  joined.  Chunks repeat, so each worker keeps the ids of the chunks it has
  seen in a bounded two-generation memo and asks the library for new ones.
* ``LibraryTokenizer``: any other file, through the library's batch call.
"""

from __future__ import annotations

import json
import os
import re
import struct

from . import common

WORD_FILE = "word_bpe_49k.json"
#: Entries in each of a memo's two generations (about 200 bytes an entry).
MEMO_ENTRIES = 400_000
#: Chunks of these characters are lower-cased and cut in Python, exactly as the
#: file's normaliser and pre-tokeniser do it; all others go to the library.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The pattern of the pre-tokeniser that ``CUT`` stands for (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path(name: str = WORD_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The character that byte-level pieces use for each byte: printable bytes
    stand for themselves, the others follow from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class Memo(dict):
    """A dict that computes missing values and forgets the older half: at
    ``limit`` entries the present generation becomes the old one."""

    def __init__(self, make, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self._room(1)
        self[key] = value
        return value

    def _room(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.old = dict(self)
            self.clear()

    def take(self, items, n: int) -> None:
        """``n`` values that were made elsewhere."""
        self._room(n)
        self.update(items)


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, models
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # the library's own cache only slows words that are all different
        self.model = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0,
                                end_of_word_suffix=model["end_of_word_suffix"])
        self.letters = byte_alphabet()
        self.runs = Memo(self._run)
        self.ids = Memo(self._chunk)
        self.lengths = Memo(lambda chunk: len(self._chunk(chunk)) // 4)

    def _run(self, run: str) -> bytes:
        marks = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
        ids = [t.id for t in self.model.tokenize(marks)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.runs.__getitem__, CUT.findall(text.lower())))
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(self, body: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.ids.__getitem__, body.split()))

    def counts_of(self, bodies: list[bytes]) -> list[int]:
        get = self.lengths.__getitem__
        return [sum(map(get, body.split())) for body in bodies]


class LibraryTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: sp.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.encode = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, body: bytes) -> bytes:
        ids = self.encode([body.decode("utf-8", "replace")])[0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def counts_of(self, bodies: list[bytes]) -> list[int]:
        return [len(x) for x in self.encode([b.decode("utf-8", "replace") for b in bodies])]


def drops_space(path: str) -> bool:
    """Whether white space only separates for this file, as ``WordTokenizer``
    needs it: read from the file, not from its name."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    return (cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") is True
            and cut.get("pattern", {}).get("Regex") == WORD_PATTERN
            and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and bool(spec["model"].get("end_of_word_suffix"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                        or not t["content"].startswith("<|") for t in spec["added_tokens"]))


_LOADED = common.cache("tokenizer")


def load(path: str):
    """The tokenizer of ``path``, once for each Python worker."""
    common.begin("tokenizer")
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path) if drops_space(path) else LibraryTokenizer(path)
    return _LOADED[path]
