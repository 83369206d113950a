"""Token ids of whole texts, with the public tokenizer files."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np


#: A run of these behind a word is one piece.
_MARKS = ".,;:!?-_()[]{}|/*+=~^%&#@$\"'"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for
    the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Little-endian uint32 ids of a text, as the tokenizer gives them with
    add_special_tokens=False.

    If the file's rules let no piece cross white space (a byte-level BPE with word ends, which
    drops white space), ids come through a bounded memory of space-free chunks; words of lower
    case Latin letters, which those rules keep whole, go straight to the merges. Texts of any
    other tokenizer are encoded whole."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        rules = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        before = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.chunked = (normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"]
                        and before[0]["behavior"] == "Removed" and before[0]["invert"] and not before[1]["add_prefix_space"]
                        and "[\\p{L}]+" in before[0]["pattern"].get("Regex", "") and rules["model"].get("end_of_word_suffix") == "</w>"
                        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"]))
        self.memory = _Memory(self.tokenizer)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.chunked:
            return _ids(self.tokenizer, text)
        if len(self.memory) > self.most:
            self.memory.clear()
        for space in "\n\t\r\x0b\x0c":
            if space in text:
                text = text.replace(space, " ")
        return b"".join(map(self.memory.__getitem__, filter(None, text.split(" "))))


def _ids(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _plain(chunk: str) -> bool:
    """Are all characters Latin letters that NFC leaves alone?"""
    try:
        chunk.encode("latin-1")
    except UnicodeEncodeError:
        return max(chunk) < "\u0250" and chunk.lower() == chunk and unicodedata.is_normalized("NFC", chunk)
    return True


class _Memory(dict):
    def __init__(self, tokenizer):
        self.tokenizer, self.merges = tokenizer, tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size() + 1)]

    def __missing__(self, chunk: str) -> bytes:
        found = None
        if chunk.isalpha():
            if chunk.isascii():
                if chunk.islower():
                    four = self.four
                    found = b"".join([four[x.id] for x in self.merges(chunk)])
                else:
                    found = self[chunk.lower()]
            elif chunk.islower() and _plain(chunk):
                four = self.four
                found = b"".join([four[x.id] for x in self.merges(chunk.encode().decode("latin-1").translate(self.letters))])
        else:
            head = chunk.rstrip(_MARKS)
            # A letter whose normal form ends in a combining mark makes one piece with what follows.
            if head != chunk and head.isalpha() and (head.isascii() or unicodedata.normalize("NFC", head).lower().isalpha()):
                found = self[head] + self[chunk[len(head):]]
        if found is None:
            found = _ids(self.tokenizer, chunk)
        self[chunk] = found
        return found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
