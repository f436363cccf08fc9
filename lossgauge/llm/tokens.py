"""Token ids of whole texts with a public tokenizer.

The ids are those of the tokenizers library. Where its file allows a proof, the merges are done by the faster engine of
tiktoken from the same file: that engine joins whatever two neighbours make an entry, the lowest id first, while the
library joins listed pairs, the first listed first. If ids rise with the list and every entry, given to the library,
comes out whole, the two agree on every text: the parts of an entry, once no earlier merge is left inside, are the pair
that the list names. Both conditions are tested when a file is loaded; else the library does all the work. It also gets
the texts with rare characters, on which the two regular-expression engines might split differently.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np

# The split of byte-level vocabularies
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# texts with other characters, or with what looks like a special token, go to the tokenizer
_UNUSUAL = re.compile(r"[^\t-\r -~À-ɏΑ-Ωα-ωЀ-ҁҊ-ԯ“”‘’–—…€]|<\|")


def _byte_symbols() -> str:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


def merge_engine(source: str, tokenizer):
    """The faster engine for a tokenizer's file, or None where it isn't proved to give the same ids."""
    import tiktoken

    content = json.loads(source)
    model, split = content["model"], content["pre_tokenizer"] or {}
    plain = content["normalizer"] is None and model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    )
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    added = {t["content"] for t in content["added_tokens"]}
    entries = {k: v for k, v in model["vocab"].items() if k not in added}
    byte_of = {c: b for b, c in enumerate(_byte_symbols())}
    if not byte_of.keys() <= entries.keys() or not all(c in byte_of for k in entries for c in k):
        return None
    order = [entries.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = max(entries[c] for c in byte_of)
    if any(a >= b for a, b in zip([single, *order], order)):
        return None
    tokenize = tokenizer.model.tokenize
    if any([t.id for t in tokenize(k)] != [v] for k, v in entries.items()):
        return None
    ranks = {bytes(byte_of[c] for c in k): v for k, v in entries.items()}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False).ids`` of a byte-level BPE file."""

    def __init__(self, path: str | None = None, source: str | None = None):
        """From the path of a tokenizer's file, or from its content."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        source = source or _content(path)
        self.tokenizer = Tokenizer.from_str(source)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.engine = merge_engine(source, self.tokenizer)
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> np.ndarray:
        usual = text.isascii() and text.isprintable() or not _UNUSUAL.search(text)
        if self.engine is None or not usual or any(t in text for t in self._added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.engine.encode_ordinary(text)
        return np.array(ids, dtype=self.dtype)


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoder_store(spark, path: str):
    """A broadcast of a tokenizer's file, some megabytes, for ``shared_encoder``: executors need not see the path."""
    return spark.sparkContext.broadcast({"source": _content(path)})


def shared_encoder(store) -> Encoder:
    """The encoder of a Python worker. ``store`` comes from ``encoder_store``; each worker holds one copy of it, and an
    encoder in it outlives the task."""
    if "encoder" not in store.value:
        store.value["encoder"] = Encoder(source=store.value["source"])
    return store.value["encoder"]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
