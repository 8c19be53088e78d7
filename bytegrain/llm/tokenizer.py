"""Public tokenizers inside tasks, and the places where a text may be cut for them.

The file travels with the plan (a few MB at most), so workers need no local copy.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: A byte-level pattern never matches across these places: before a space that a visible
#: ASCII sign, letter or digit follows, and before a lone line feed between two of those.
CUT = re.compile(r"(?= [!-~\w])|(?<=[!-~\w])(?=\n[!-~\w])")

LONG_CHARS = 1 << 16


@dataclass(frozen=True)
class TokenizerFile:
    """A vocabulary file: `.json` of tokenizers or `.model` of sentencepiece."""

    kind: str
    content: bytes

    @staticmethod
    def read(path: str) -> TokenizerFile:
        kind = os.path.splitext(path)[1].lstrip(".")
        if kind not in ("json", "model"):
            raise ValueError(f"neither a .json nor a .model file: {path}")
        with open(path, "rb") as file:
            return TokenizerFile(kind, file.read())

    def load(self) -> Encoder:
        return _load(self.kind, self.content)


@functools.lru_cache(maxsize=4)
def _load(kind: str, content: bytes) -> Encoder:
    return JsonEncoder(content) if kind == "json" else PieceEncoder(content)


class Encoder:
    """`spans` cuts a text into lists of words that encode on their own; `encode` gives ids."""

    def spans(self, text: str) -> Iterator[list[str]]:
        yield [text]

    def encode(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError


class JsonEncoder(Encoder):
    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        added = sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))
        pre = spec.get("pre_tokenizer") or {}
        #: whether words encode on their own; otherwise a whole text is one word
        self.cuts = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and spec.get("normalizer") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        names = [re.escape(t["content"]) for t in added]
        self.special = re.compile("(" + "|".join(names) + ")") if names else None

    def spans(self, text: str) -> Iterator[list[str]]:
        if not self.cuts:
            yield [text]
            return
        named = self.special is not None and self.special.search(text)
        for place, part in enumerate(self.special.split(text) if named else [text]):
            if place % 2:
                yield [part]
            else:
                yield from map(CUT.split, chunks(part))

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pieces(self) -> list[tuple[int, bytes]]:
        """Every id with the bytes it decodes to; for byte-level vocabularies only."""
        if not self.cuts:
            raise ValueError("pieces are defined for byte-level vocabularies")
        added = {t: t_.content for t, t_ in self.tokenizer.get_added_tokens_decoder().items()}
        signs = {chr(b if shown(b) else 256 + HIDDEN.index(b)): b for b in range(256)}
        return [
            (i, added[i].encode() if i in added else bytes(signs[c] for c in token))
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items()
        ]


class PieceEncoder(Encoder):
    def __init__(self, content: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.processor.encode(words, num_threads=1, add_bos=False, add_eos=False)


def shown(byte: int) -> bool:
    """Whether a byte-level vocabulary writes the byte as its own Latin-1 sign."""
    return 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte <= 0xFF


HIDDEN = [b for b in range(256) if not shown(b)]


def chunks(text: str, size: int = LONG_CHARS) -> Iterator[str]:
    """A long text in parts of about `size` characters, cut where words may be cut."""
    start = 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text
