"""Token ids of whole texts by the tokenizers library, with a bounded per-worker memory of words."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: Id that ends every document.
END = (2).to_bytes(4, "little")
#: Words and pieces a worker remembers; beyond that it forgets those that the texts at hand don't need.
MAX_WORDS, MAX_PIECES = 300_000, 200_000
#: Words or pieces that the library encodes at once.
BATCH = 2_000
#: Bytes of text taken apart at once (a longer text by itself), and words whose ids are copied at once.
CHUNK, COPIED = 8 << 20, 1 << 16
#: Texts with these take the library's own path: special tokens' first characters, and separators that
#: Arrow takes for white space but the tokenizer doesn't.
_ODD = r"<\||[\x1C-\x1F]"
#: Words with these are left to the library; others are lower-cased and taken apart here.
_FOREIGN = r"[^\x00-\x{12F}\x{131}-\x{24F}]"
#: The only rule for pieces that is followed here: a word of letters alone is one piece. By another rule all words are foreign.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _copied(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at starts, one after another."""
    out = []
    for k in range(0, len(starts), COPIED):
        size = sizes[k : k + COPIED]
        ends = np.cumsum(size)
        out.append(ids[np.repeat(starts[k : k + COPIED] - (ends - size), size) + np.arange(ends[-1])])
    return np.concatenate(out) if out else ids[:0]


class WordEncoder:
    """Encodes texts as the whole-text call of the library would, but each distinct word once.

    This holds for tokenizers whose pieces never span white space. Arrow splits and counts the words of many
    texts together, so only distinct pieces come to Python. On words that aren't foreign NFC changes nothing, and
    Arrow lower-cases as the library does.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: only tokenizers that lower-case and drop white space are supported")
        self.foreign = _FOREIGN if steps[0]["pattern"].get("Regex") == _RULE else ""
        self.whole = Tokenizer.from_file(path)
        self.piece = Tokenizer.from_file(path)  # of a piece a line, neither normalised nor split further
        self.piece.normalizer = normalizers.Sequence([])
        self.piece.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = spec["model"].get("end_of_word_suffix") or "\0"
        self.ends = np.zeros(self.piece.get_vocab_size(), bool)
        self.ends[[i for token, i in self.piece.get_vocab().items() if token.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"": b""}

    @staticmethod
    def of(path: str) -> WordEncoder:
        """This process's encoder; it outlives tasks where Spark reuses its workers."""
        return held("encoder", path, lambda: WordEncoder(path))

    @staticmethod
    def _known(memory: dict[str, bytes], keys: list[str], most: int, learn: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all keys, and where each one's begin and how many they are; keys not yet in memory are learnt."""
        new = [k for k in keys if k not in memory]
        if len(memory) + len(new) > most:
            # What these texts share with those before is what is frequent.
            frequent = {k: memory[k] for k in keys if k in memory}
            memory.clear()
            memory.update(frequent, **{"": b""})
        for at in range(0, len(new), BATCH):
            memory.update(learn(new[at : at + BATCH]))
        coded = [memory[k] for k in keys]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        return np.frombuffer(b"".join(coded), "<u4"), np.cumsum(sizes) - sizes, sizes

    def _whole(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        return [(w, array("I", x.ids).tobytes()) for w, x in zip(words, self.whole.encode_batch_fast(words, add_special_tokens=False))]

    def _coded(self, pieces: list[str]) -> Iterable[tuple[str, bytes]]:
        """Each piece with its ids. All go as one text of a line each, as an answer per piece would cost many
        times the piece; ids that end a word part the lines. Where they don't, each piece goes by itself."""
        (found,) = self.piece.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1) if len(ids) else np.empty(0, np.int64)
        if len(ends) != len(pieces):
            return [(p, array("I", x.ids).tobytes()) for p, x in zip(pieces, self.piece.encode_batch_fast(pieces, add_special_tokens=False))]
        data, ends = ids.tobytes(), ends.tolist()
        return zip(pieces, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)))

    def _taken_apart(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _known, of distinct words; each distinct piece of them is looked up once."""
        foreign = pc.match_substring_regex(words, self.foreign)
        low = pc.utf8_lower(words.filter(pc.invert(foreign)))
        single = pc.utf8_is_alpha(low)
        alone = low.filter(single)
        parted = pc.ascii_split_whitespace(pc.replace_substring_regex(low.filter(pc.invert(single)), f"({_RULE})", r"\1 "))
        pieces = pa.concat_arrays([alone, parted.values]).dictionary_encode()
        ids, starts, sizes = self._known(self.pieces, pieces.dictionary.to_pylist(), MAX_PIECES, self._coded)
        index = pieces.indices.to_numpy()
        ids = _copied(ids, starts[index], sizes[index])
        before = np.concatenate([[0], np.cumsum(sizes[index])])
        # Words of one piece come first, then the others; each begins at the piece that its list begins at.
        bounds = before[np.concatenate([np.arange(len(alone)), len(alone) + parted.offsets.to_numpy()])]
        other, one = np.flatnonzero(~np.asarray(foreign)), np.asarray(single)
        rest, rest_starts, rest_sizes = self._known(self.words, words.filter(foreign).to_pylist(), MAX_WORDS, self._whole)
        places = np.concatenate([other[one], other[~one], np.flatnonzero(foreign)])
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[places] = np.concatenate([bounds[:-1], len(ids) + rest_starts])
        sizes[places] = np.concatenate([np.diff(bounds), rest_sizes])
        return np.concatenate([ids, rest]), starts, sizes

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        # Every text ends with one word more: the end id or, of an odd text, which has no other words, all its ids.
        last = [END, *(array("I", self.whole.encode(t, add_special_tokens=False).ids).tobytes() + END for t in texts.filter(odd).to_pylist())]
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts) if len(last) > 1 else texts)
        words = lists.values.dictionary_encode()
        ids, starts, sizes = self._taken_apart(words.dictionary)
        last_sizes = np.array([len(x) // 4 for x in last], np.int64)
        starts = np.concatenate([starts, len(ids) + np.cumsum(last_sizes) - last_sizes])
        sizes = np.concatenate([sizes, last_sizes])
        ids = np.concatenate([ids, np.frombuffer(b"".join(last), "<u4")])
        odd = np.asarray(odd)
        ends = lists.offsets.to_numpy()[1:] + np.arange(len(texts))
        index = np.empty(len(words) + len(texts), np.int64)
        inner = np.ones(len(index), bool)
        inner[ends] = False
        index[inner] = words.indices.to_numpy()
        index[ends] = len(words.dictionary) + np.cumsum(odd) * odd
        sizes = sizes[index]
        return _copied(ids, starts[index], sizes), np.add.reduceat(sizes, np.concatenate([[0], ends[:-1] + 1]))

    def runs(self, texts: pa.Array, chunk: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one row range after another, of about chunk (else CHUNK) bytes: the ids (unsigned 32-bit) of its texts, each with the
        end id, and how many each text has. Null is empty."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (chunk or CHUNK), "right")))
            yield self._together(texts.slice(at, to - at))
            at = to

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text, each with the end id; null is empty."""
        return [x.tobytes() for ids, sizes in self.runs(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(sizes)[:-1])]
