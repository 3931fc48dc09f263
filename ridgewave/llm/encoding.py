"""Exact token ids and counts of whole texts, one encoder a worker process.

:func:`encoder` picks by what the tokenizer file says:

* byte-level BPE with the common pattern, no normaliser, and merges in the order of their ids: such a file means
  the same as a table of ranks, and the library for rank tables gives the same ids several times as fast
  (:class:`RankEncoder`; nothing is kept between texts);
* BPE that drops white space and never joins across it (:class:`WordEncoder`): most words of a corpus repeat, so the
  token counts of words are kept, in a table bounded in entries that is emptied at the end of each task, and the
  tokenizer library is asked for new words only, in batches balanced by bytes;
* any other file: whole texts go to its own library.

Texts are only cut where no token can cross with the tokenizer at hand.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Words kept by a worker, about 150 bytes each; the table starts anew beyond it, which only costs time.
TABLE_WORDS = 150_000
#: Bytes of new words given to the tokenizer library at once.
BATCH_BYTES = 1 << 18
#: The pattern of byte-level pre-tokenisers that use one.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: ASCII marks at a word's end (an apostrophe could start a contraction); behind an ASCII letter, which no
#: normalisation turns into anything but a letter, no token spans letter and mark.
_TAIL = re.compile(rb"(?<=[A-Za-z])[!-&(-/:-@\[-`{-~]+\Z")


def _plain(spec: dict) -> bool:
    """Whether added tokens are matched as they stand."""
    return all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in spec["added_tokens"])


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: bytes that print stand for themselves, the rest follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """Bytes -> rank of a byte-level file that means the same as a rank table, else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or not _plain(spec):
        return None
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    vocab, byte = model["vocab"], _byte_alphabet()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    own = {t: i for t, i in vocab.items() if t not in added}
    if made != sorted(set(made)) or len(own) != len(made) + 256 or not all(set(t) <= byte.keys() for t in own):
        return None
    return {bytes(byte[c] for c in t): i for t, i in own.items()}


#: Characters of white space in one run that the rank library's pattern takes without fail; it gives up at about a million.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


class RankEncoder:
    """Byte-level BPE by a table of ranks; texts with a very long run of white space go to the file's own library."""

    def __init__(self, path: str, spec: dict, ranks: dict[bytes, int]):
        import tiktoken

        self._path, self._own = path, None
        self._model = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        return [self._whole(t) if len(t) >= LONG_SPACE and _LONG_SPACE.search(t) else np.asarray(self._model.encode_to_numpy(t, allowed_special="all"), "<u4").tobytes() for t in texts]

    def _whole(self, text: str) -> bytes:
        self._own = self._own or WholeEncoder(self._path)
        return self._own.ids([text])[0]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.ids(texts)]

    def end_task(self) -> None:
        pass


class WholeEncoder:
    """Any tokenizer file by its own library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda batch: model.encode(batch, num_threads=1)
        else:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(path)
            self._encode = lambda batch: [e.ids for e in self._model.encode_batch_fast(batch, add_special_tokens=False)]

    @staticmethod
    def _batches(texts):
        batch, size = [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                yield batch
                batch, size = [], 0
        if batch:
            yield batch

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for batch in self._batches(texts) for x in self._encode(batch)]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for batch in self._batches(texts) for x in self._encode(batch)]

    def end_task(self) -> None:
        pass


class WordEncoder(WholeEncoder):
    """Counts by word for tokenizers that drop white space."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        super().__init__(path)
        self._added = [t.content.encode() for t in self._model.get_added_tokens_decoder().values()]
        self._mark = min(self._added, default=None)
        self._mark_id = self._encode([self._mark.decode()])[0][0] if self._mark else None
        self._table: dict[bytes, int] = {}
        self._parts: dict[bytes, int] = {}
        self._most = table_words

    @staticmethod
    def fits(spec: dict) -> bool:
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return bool(parts and _plain(spec) and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", ""))

    def _counted(self, units: list[bytes]):
        """Each unit with its number of tokens, from few calls: an added token, which touches no other, stands between units."""
        for batch in self._batches(units):
            apart = [u for u in batch if self._mark is None or self._mark in u]
            yield from zip(apart, map(len, self._encode([u.decode() for u in apart])))
            batch = [u for u in batch if self._mark is not None and self._mark not in u]
            if batch:
                ids = np.array(self._encode([self._mark.join(batch).decode()])[0], np.int64)
                ends = np.append(np.flatnonzero(ids == self._mark_id), len(ids))
                if len(ends) != len(batch):
                    raise ValueError("the mark isn't one token of its own")
                yield from zip(batch, (np.diff(ends, prepend=-1) - 1).tolist())

    def _learn(self, words: list[bytes]) -> None:
        """Enter new words; marks that end a word are looked up apart, so fewer words are new to the library."""
        cut = []
        for w in words:
            m = _TAIL.search(w)
            k = m.start() if m and not (b">" in w and any(t in w for t in self._added)) else len(w)
            cut.append((w, w[:k], w[k:]))
        if len(self._parts) > self._most:
            self._parts.clear()
        parts = self._parts
        parts.update(self._counted(list({p for _, *both in cut for p in both}.difference(parts))))
        parts[b""] = 0
        self._table.update((w, parts[a] + parts[b]) for w, a, b in cut)

    def lengths(self, texts: list[str]) -> list[int]:
        words = [t.encode("utf-8").split() for t in texts]
        if len(self._table) > self._most:
            self._table.clear()
        if new := set().union(*words).difference(self._table) if words else ():
            self._learn(list(new))
        get = self._table.__getitem__
        return [sum(map(get, w)) for w in words]

    def end_task(self) -> None:
        self._table.clear()
        self._parts.clear()


def make_encoder(path: str):
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (ranks := ranks_of(spec)) is not None:
            return RankEncoder(path, spec, ranks)
        if WordEncoder.fits(spec):
            return WordEncoder(path)
    return WholeEncoder(path)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The worker process's encoder of this file."""
    return make_encoder(path)


def by_bytes(column, limit: int = 1 << 20):
    """(first row, texts) of runs of an Arrow text column of about ``limit`` characters each."""
    start, texts, size = 0, [], 0
    for k in range(len(column)):
        t = column[k].as_py() or ""
        texts.append(t)
        size += len(t) + 64
        if size >= limit:
            yield start, texts
            start, texts, size = k + 1, [], 0
    if texts:
        yield start, texts
