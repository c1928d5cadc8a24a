"""Byte-pair encoding by dynamic programming over prefixes.

A BPE encoding of a prefix is unique, and so is its last token: the one token t that ends there such that the encoding
of what comes before t ends in a token s with encode(s + t) == [s, t] (s and t are compatible). So one pass from left
to right stores the last token of every prefix; the tokens that end at a place come from an automaton of the
vocabulary, and the back-pointers from the end give the encoding. Stored counts answer for every prefix at once.

Nothing here imports Spark.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick

#: Pieces longer than this are not remembered, and no more pieces than that at a time.
LONGEST_KEPT, MOST_KEPT = 48, 200_000


class PrefixBpe:
    """Last tokens of all prefixes of a string of symbols, one character each (``end`` belongs to the symbol before it).

    rank(a, b) is the priority with which the neighbours a and b merge (smaller first, then leftmost) or None.
    """

    def __init__(self, tokens, rank, end: str = "") -> None:
        self.rank, self.end, self.tested = rank, end, 0
        self.automaton = ahocorasick.Automaton()
        for t in tokens:
            self.automaton.add_word(t, (t, len(t) - 1, {}))  # and what was found of the tokens before it
        self.automaton.make_automaton()

    def symbols(self, s: str) -> list[str]:
        out = list(s)
        if self.end and out and out[-1] == self.end and len(out) > 1:
            out[-2:] = ["".join(out[-2:])]
        return out

    def merged(self, s: str) -> list[str]:
        """The encoding of a short string by merging, for the compatibility tests."""
        parts = self.symbols(s)
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = self.rank(parts[at], parts[at + 1])
            if at:
                ranks[at - 1] = self.rank(parts[at - 1], parts[at])

    def compatible(self, s: str, t: str) -> bool:
        """Whether encode(s + t) == [s, t]; with s empty, whether t is its own encoding."""
        return self.merged(s + t) == ([s, t] if s else [t])

    def last_tokens(self, s: str) -> list[str]:
        """For each place in s, the last token of the encoding of what ends there; a lone unknown symbol is its own token."""
        last: list[str | None] = [None] * (len(s) + 1)
        last[0] = ""
        for at, (t, less, tested) in self.automaton.iter(s):
            if last[at + 1] is None:
                before = last[at - less]
                if before is None:
                    before = last[at - less] = s[at - less - 1]  # no token ends there: unknown
                known = tested.get(before)
                if known is None:
                    self.tested += 1
                    if self.tested > MOST_KEPT:
                        self.forget()
                    known = tested[before] = self.compatible(before, t)
                if known:
                    last[at + 1] = t
        del last[0]
        return [s[i] if t is None else t for i, t in enumerate(last)] if None in last else last

    def forget(self) -> None:
        for _, _, tested in self.automaton.values():
            tested.clear()
        self.tested = 0

    def tokens(self, s: str) -> list[str]:
        last, at, out = self.last_tokens(s), len(s) - 1, []
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]


class Kept(dict):
    """make(key) for each key, remembering bounded numbers of short keys."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[key] = value
        return value


class PieceCounter:
    """Token counts of every prefix of a text, for a sentencepiece BPE model with byte fallback and no normalisation."""

    MARK = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        score = {model.id_to_piece(i): -model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        for p in score:
            if self.MARK in p.lstrip(self.MARK):
                raise ValueError(f"the piece {p!r} crosses the start of a word")
        if len(model.encode("  a  b")) != len(model.encode("  a  b ")) - 1 or model.encode("ﬁ") == model.encode("fi"):
            raise ValueError("models that change or drop characters are not supported")
        self.known = frozenset(p for p in score if len(p) == 1)
        inner = {c for p in score if len(p) > 1 for c in p}
        self.bpe = PrefixBpe(score, lambda a, b: score.get(a + b))
        # Line ends in no longer piece part the text like the starts of words do.
        stop = "" if "\n" in inner else "\n"
        self.cut = re.compile(f" +[^ {stop}]*|[^ {stop}]+" + (f"|{stop}" if stop else ""))
        self.counts = Kept(self._counts)

    def _weight(self, token: str) -> int:
        return 1 if len(token) > 1 or token in self.known else len(token.encode("utf-8", "surrogatepass"))

    def _counts(self, chunk: str) -> bytes | array:
        """The token counts of the chunk's prefixes of 1, 2, ... characters."""
        counts: list[int] = []
        known = self.known
        for at, t in enumerate(self.bpe.last_tokens(chunk.replace(" ", self.MARK))):
            size = len(t)
            before = counts[at - size] if size <= at else 0
            counts.append(before + (1 if size > 1 or t in known else self._weight(t)))
        return bytes(counts) if max(counts) < 256 else array("i", counts)

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(" " + text.replace(self.MARK, " ")) if text else []

    def total(self, text: str) -> int:
        return self.measure(text, 0)[0]

    def prefix_counts(self, text: str) -> array:
        """For k = 0, 1, ... len(text): the number of tokens of text[:k]."""
        out, base = array("i"), 0
        for chunk in self.chunks(text):
            counts = self.counts[chunk]
            out.extend([base + c for c in counts])
            base += counts[-1]
        if not out:
            return array("i", [0])
        out[0] = 0  # the mark before the first character counts with that character
        return out

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """The number of tokens, and the largest k for which text[:k] has at most ``budget``, whether or not shorter
        prefixes have more. Both are read from the stored counts of the chunks' prefixes."""
        found = list(map(self.counts.__getitem__, self.chunks(text)))
        whole = sum([c[-1] for c in found])
        if whole <= budget:
            return whole, len(text)
        base, at, best = 0, -1, 0
        for counts in found:
            # A prefix inside a chunk may have more tokens than the whole chunk; it has none fewer than base + 1.
            if base >= budget:
                break
            if base + counts[-1] <= budget:
                best = at + len(counts)
            else:
                best = max([best, *(at + k for k, c in enumerate(counts, 1) if base + c <= budget)])
            base, at = base + counts[-1], at + len(counts)
        return whole, max(best, 0)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class WordBpe:
    """Encoding and decoding with a tokenizers file of lower-case words with word ends, as that library gives them."""

    #: Below this, what the library and Python know of letters, numbers and lower case agrees, and nothing composes.
    PLAIN = "ɐ"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or spec["decoder"] is not None or not self.suffix:
            raise ValueError("a BPE model with word ends and no decoder is expected")
        end = ""
        short = lambda t: t[: -len(self.suffix)] + end if t.endswith(self.suffix) else t
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        rank = {(short(a), short(b)): r for r, (a, b) in enumerate(pairs)}
        self.ids = {short(t): i for t, i in model["vocab"].items()}
        self.names = {i: t for t, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in special.items()}
        self.special = {t: i.to_bytes(4, "little") for t, i in special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.bpe, self.end = PrefixBpe(self.ids, lambda a, b: rank.get((a, b)), end), end
        self.letters = byte_letters()
        self.packed = Kept(lambda word: self._pack("".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))))
        self.mapped = Kept(self._pack)
        self.rare = re.compile(f"[^\\x00-{chr(ord(self.PLAIN) - 1)}]")
        self.words = re.compile(self._pattern())

    def _pattern(self) -> str:
        """The file's splitting pattern for characters below PLAIN."""
        import unicodedata

        plain = [chr(i) for i in range(ord(self.PLAIN))]
        of = lambda kind: "".join(c for c in plain if unicodedata.category(c)[0] == kind)
        letters, numbers, space = re.escape(of("L")), re.escape(of("N")), "\\t-\\r \\x85\\xa0"
        return f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"

    def _pack(self, mapped: str) -> bytes:
        return b"".join(self.ids[t].to_bytes(4, "little") for t in self.bpe.tokens(mapped + self.end))

    def _part(self, text: str) -> bytes:
        if self.rare.search(text):
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
            return b"".join([self.mapped[w] for w, _ in split])
        return b"".join(map(self.packed.__getitem__, self.words.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<" not in text:
            return self._part(text)
        return b"".join(self.special.get(p) or self._part(p) for p in self.specials.split(text) if p)

    def decode(self, ids) -> str:
        return " ".join(map(self.names.__getitem__, ids))
