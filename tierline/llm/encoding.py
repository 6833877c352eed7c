"""Tokenizer access for Spark tasks: exact ids with a bounded memo of text pieces.

A text of plain characters only (printable ASCII, tab, line breaks and Latin-1
letters) is split by the vocabulary's own pre-token pattern, whose classes are
plain sets there; its normal form is the text itself or its lower case. Each
distinct pre-token goes through the library's BPE model once per memo
generation.

Any other text is cut into chunks at spaces between two Latin letters. Both
public vocabularies always break a pre-token there, normalise each side on its
own and never let a special string span it, so a text's ids are the
concatenation of its chunks' ids, each encoded by the library as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Sequence

import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

from tierline.llm.common import MEMOS

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_CUT = re.compile(f"(?<=[{_LATIN}]) (?=[{_LATIN}])")
_NOT_PLAIN = re.compile(f"[^ -~\\t\\n\\r{_LATIN[6:]}]|<\\|")     # "<|" may begin a special string

MEMO_PIECES = 250_000   # entries kept before a memo starts afresh: about 50 MB, as entries are short
MEMO_CHARS = 48         # longer chunks are encoded but not remembered

_LOADED: dict[str, object] = {}


def load(name: str):
    """The tokenizer of a public vocabulary file, once per Python process."""
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _LOADED[name]


def version_digest(name: str) -> str:
    """SHA-256 of the vocabulary file: the tokenizer version that counts belong to."""
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class PieceMemo:
    """Encodes texts piece by piece; ``value`` turns a piece's ids into what is kept."""

    def __init__(self, name: str, value: Callable):
        self.tokenizer = load(name)
        self.value = value
        self.chunks: dict[str, object] = {}
        self.pretokens: dict[str, object] = {}
        spec = json.loads(self.tokenizer.to_str())
        normal = json.dumps(spec["normalizer"])
        self.lower = "Lowercase" in normal
        split = [p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        pattern = split[0]["pattern"]["Regex"] if split else public_tokenizers.PATTERN
        # on plain characters the Unicode classes are these sets
        inside = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(
            r"[^\s\p{L}\p{N}]", f"[^ \\t\\n\\r0-9{_LATIN}]")
        inside = inside.replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
        inside = inside.replace(r"(?!\S)", r"(?![^ \t\n\r])").replace(r"\s", r"[ \t\n\r]")
        self.pattern = re.compile(inside)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in (*range(32, 127), 9, 10, 13, *range(0xC0, 0x100))]
        self.byte_level = str.maketrans({c: "".join(p for p, _ in level.pre_tokenize_str(c)) for c in plain})

    def _fill_chunks(self, chunks: set[str], into: dict) -> None:
        todo = list(chunks)
        for at in range(0, len(todo), 2000):
            part = todo[at:at + 2000]
            for chunk, enc in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                into[chunk] = self.value(enc.ids)

    def _plain(self, text: str) -> list:
        memo, bpe = self.pretokens, self.tokenizer.model.tokenize
        parts = self.pattern.findall(text.lower() if self.lower else text)
        new = set(parts).difference(memo)
        for p in new:
            memo[p] = self.value([t.id for t in bpe(p.translate(self.byte_level))])
        out = [memo[p] for p in parts]
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        if len(memo) > MEMO_PIECES:
            self.pretokens = {}
        return out

    def _mixed(self, text: str) -> list:
        memo, extra = self.chunks, {}
        first, *rest = _CUT.split(text)
        parts = [first, *[" " + p for p in rest]]
        new = set(parts).difference(memo)
        self._fill_chunks({p for p in new if len(p) <= MEMO_CHARS}, memo)
        self._fill_chunks({p for p in new if len(p) > MEMO_CHARS}, extra)
        out = [extra[p] if p in extra else memo[p] for p in parts]
        if len(memo) > MEMO_PIECES:
            self.chunks = {}
        return out

    def values(self, texts: Sequence[str]) -> list[list]:
        """Per text, the values of its pieces in order."""
        return [self._mixed(t) if _NOT_PLAIN.search(t) else self._plain(t) for t in texts]


def piece_memo(name: str, value: Callable) -> PieceMemo:
    """The process's memo for a tokenizer and a value function; tasks of one worker share it."""
    key = (name, value.__module__, value.__qualname__)
    if key not in MEMOS:
        MEMOS[key] = PieceMemo(name, value)
    return MEMOS[key]


def n_ids(ids: Sequence[int]) -> int:
    return len(ids)


def id_bytes(ids: Sequence[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)
