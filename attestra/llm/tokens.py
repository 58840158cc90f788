"""Token ids of whole texts, with a bounded memory of words that a worker has already encoded."""

from __future__ import annotations

import re

import numpy as np

# Words that a Python worker keeps at most; beyond it starts anew, so memory stays bounded whatever the vocabulary.
KNOWN_WORDS = 800_000
# The characters of Unicode's White_Space property (fixed values).
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = re.compile(f"[^{WHITE_SPACE}]+")
SEPARATORS_OF_STR_SPLIT = re.compile("[\x1c-\x1f]")
MARK = "<|endoftext|>"


_tokenizers: dict = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one per process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _tokenizers[path] = tokenizer
    return _tokenizers[path]


def encode_words(tokenizer, words: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each word; many are encoded together, parted by a special token."""
    mark = tokenizer.token_to_id(MARK)
    out: list[bytes] = [b""] * len(words)
    alone = [k for k, w in enumerate(words) if "<|" in w or not w]
    together = [k for k, w in enumerate(words) if w and "<|" not in w]
    for at in range(0, len(together), 2000):
        part = together[at:at + 2000]
        ids = np.array(tokenizer.encode_batch_fast([MARK.join([words[k] for k in part])], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == mark)
        begin, end = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
        raw = ids.tobytes()
        for k, b, e in zip(part, begin, end, strict=True):
            out[k] = raw[4 * b:4 * e]
    for k in alone:
        out[k] = np.array(tokenizer.encode(words[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
    return out


# Runs of letters and of marks that a tokenizer takes as one piece each, without digits and apostrophes (ASCII and Latin-1).
RUNS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[!-&(-/:-@\[-`{-~]+")
PLAIN = re.compile(f"(?:{RUNS.pattern})+")


def runs_of(word: str) -> list[str] | None:
    """The runs of a word in small letters; none if it holds anything else."""
    if word.isascii() and word.isalpha():
        return [word.lower()]
    return RUNS.findall(word.lower()) if PLAIN.fullmatch(word) and "<|" not in word else None


def run_tokenizer(path: str):
    """The tokenizer of a file for runs parted by single spaces: they are normal already and one piece each, so nothing searches for these."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class WordEncoder:
    """Encodes texts like a tokenizer file that drops white space: the ids of a text are those of its words in turn.

    Its vocabulary marks the last piece of a run of letters, marks or digits with `</w>` and knows small letters only. A new word
    of plain runs takes the ids of these; new runs are encoded as one text and told apart by the marks. Other words
    are encoded as `encode_words` does.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.pieces = run_tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        cut = list(map(runs_of, words))
        rest = [w for w, runs in zip(words, cut) if runs is None]
        if rest:
            words, cut = [w for w, runs in zip(words, cut) if runs is not None], [runs for runs in cut if runs is not None]
        if len(self.runs) > KNOWN_WORDS:
            self.runs.clear()
        new = list({r for runs in cut for r in runs if r not in self.runs})
        for at in range(0, len(new), 4000):
            part = new[at:at + 4000]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark the ends of runs")
            bounds = [0, *(4 * (ends + 1)).tolist()]
            raw = ids.tobytes()
            self.runs.update((r, raw[a:b]) for r, a, b in zip(part, bounds, bounds[1:]))
        self.known.update((w, self.runs[runs[0]] if len(runs) == 1 else b"".join(map(self.runs.__getitem__, runs))) for w, runs in zip(words, cut))
        self.known.update(zip(rest, encode_words(self.tokenizer, rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [WORD.findall(t) if SEPARATORS_OF_STR_SPLIT.search(t) else t.split() for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = set()
        for words in split:
            new.update(words)
        self._learn(list(new.difference(self.known)))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so its memory of words serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
