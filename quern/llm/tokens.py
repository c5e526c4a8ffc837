"""Token ids of whole texts, each distinct piece encoded once and kept.

The byte-level pre-tokenizer never joins a character that isn't white space
with white space after it, nor a letter with a sign after it (but for an
apostrophe). A text without adjacent white space may therefore be cut before
spaces, around line ends and between letters and signs; the pieces' ids, one
after another, are the text's. Texts with adjacent white space are encoded whole,
and so is every text where the tokenizer has another pre-tokenizer or a normalizer.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.common import trim

#: Characters of text cut at once, and pieces kept in each of two generations.
BATCH_BYTES, KEPT = 4 << 20, 150_000
_WIDE_GAP = r"[\s\x0b\x{85}\p{Z}]{2}|[\x00\x01]"
_SIGNS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:%$#*&|]+)"
_NUL, _CUT = "\x00", "\x01"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Encoder:
    """Encodes lists of texts with one tokenizer file, keeping frequent pieces."""

    def __init__(self, path: str):
        self.model = tokenizer(path)
        self.nul = self.model.encode(_NUL, add_special_tokens=False).ids
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # the cuts are right for the byte-level pre-tokenizer's own pattern and without a normalizer
        spec = json.loads(self.model.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        # pieces may be told apart by NUL only where no token but its own holds it
        own = [v for k, v in self.model.get_vocab().items() if self.model.decoder and _NUL in self.model.decoder.decode([k])]
        self.by_nul = len(self.nul) == 1 and own == self.nul
        # tokens that begin with a space: in words behind one space each, these and no others begin a word
        size = max(self.model.get_vocab().values(), default=0) + 1
        self.spaced = np.zeros(size, bool)
        if self.by_nul:
            self.spaced[[v for k, v in self.model.get_vocab().items() if self.model.decoder.decode([k])[:1] == " "]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, none of which holds NUL, starts with ' or ends with white space."""
        if not self.by_nul or not pieces:
            return self.whole(pieces)
        ids = np.array(self.model.encode_batch_fast([_NUL.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ids == self.nul[0])
        if len(cut) != len(pieces) - 1:
            return self.whole(pieces)
        raw, at = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
        end = [*(4 * cut).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(at, end)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each piece that is one space and then characters that aren't white space."""
        if not self.by_nul or not words:
            return self.whole(words)
        ids = np.array(self.model.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(words) or at[0] != 0:
            return self.pieces(words)
        raw, cut = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        out: list[bytes] = [b""] * len(texts)
        i, size = 0, 0
        for j, t in enumerate(texts):
            if size and size + len(t or "") > BATCH_BYTES:
                self._some(texts, i, j, out)
                i, size = j, 0
            size += len(t or "")
        self._some(texts, i, len(texts), out)
        trim()
        return out

    def _learn(self, known: list[str]) -> None:
        """Have all pieces in ``kept``; those not met for a generation are forgotten."""
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}
        new = set(known).difference(self.kept)
        if self.older:
            self.kept.update((k, self.older[k]) for k in new.intersection(self.older))
            new.difference_update(self.older)
        # no text cut here has adjacent white space, so a piece after a space has none but that
        words = [k for k in new if k[:1] == " " and not k[-1].isspace()]
        self.kept.update(zip(words, self.words(words)))
        new.difference_update(words)
        plain = [k for k in new if k and k[0] != "'" and not k[-1].isspace()]
        self.kept.update(zip(plain, self.pieces(plain)))
        rest = list(new.difference(plain))
        self.kept.update(zip(rest, self.whole(rest)))

    def _some(self, texts: list[str | None], i: int, j: int, out: list[bytes]) -> None:
        if not self.cuts:
            out[i:j] = self.whole([t or "" for t in texts[i:j]])
            return
        part = pa.array(["" if t is None else t for t in texts[i:j]], pa.large_string())
        odd = pc.match_substring_regex(part, _WIDE_GAP).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(odd):
            out[i + k] = self.whole([texts[i + k]])[0]
        usual = np.flatnonzero(~odd)
        if not len(usual):
            return
        marked = pc.replace_substring(part.take(pa.array(usual)), " ", _CUT + " ")
        del part
        marked = pc.replace_substring(marked, "\n", f"{_CUT}\n{_CUT}")
        cut = pc.split_pattern(pc.replace_substring_regex(marked, _SIGNS, rf"\1{_CUT}\2"), _CUT)
        del marked
        counts = pc.list_value_length(cut).to_numpy()
        coded = cut.flatten().dictionary_encode()
        del cut
        known, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        del coded
        self._learn(known)
        ids = list(map(self.kept.__getitem__, known))
        del known
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // np.int32(4)
        pool, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size, dtype=np.int32) - size
        del ids
        each = size[index]
        total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        # a batch has far fewer than 2**31 ids
        place = np.repeat(begin[index] - total[:-1].astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        raw = pool[place].tobytes()
        del place, pool, each, index
        ends = 4 * total[np.concatenate([[0], np.cumsum(counts)])]
        for k, a, b in zip(usual.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            out[i + k] = raw[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; its kept pieces outlive a task."""
    return Encoder(path)
