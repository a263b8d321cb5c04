"""SentencePiece vocabularies read as a unigram lattice: streaming Viterbi encoding, and decoding.

Text is spelt as the model's normaliser does (identity): blanks become U+2581, one more is put before the text. The
best segmentation maximises the sum of piece scores; of equal sums, the one whose last piece is longer, at each end.
A code point without a piece falls back to its bytes, at the lowest score less ten.

The streaming encoder holds the scores of the ends that a piece can still reach, at most twice the longest piece, and a
backpointer for each code point that isn't given out yet. Whenever all of those ends lead back through one boundary,
the ids before it are final and are given out; this is looked for each `longest piece` code points. No piece of these vocabularies goes on after a U+2581 inside it but
runs of blanks, and none holds a line end: before a run of blanks and around a line end all paths converge, which lets
the ids of a short unit between them be remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from glossa.llm.op08_packing import WordIds

BLANK = "▁"
SPLIT = re.compile("\n|▁+[^\n▁]*|[^\n▁]+")
#: Longer units aren't remembered.
REMEMBERED = 64
#: Code points that the encoder takes in at a time.
CHUNK = 4096
LOWEST = float("-inf")
NOWHERE: tuple[dict, float | None, int] = ({}, None, -1)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, their scores, and the bytes that each id stands for. `trie`: code point to (deeper trie, score or None, id)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[str, tuple[float, int]] = {}
        spelt: list[bytes] = []
        single = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                single[int(piece[3:5], 16)] = i
                spelt.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                spelt.append(b"")
            else:
                pieces[piece] = (model.get_score(i), i)
                spelt.append(piece.replace(BLANK, " ").encode())
        self._set(pieces, spelt, single)

    @classmethod
    def of_pieces(cls, scores: dict[str, float]) -> Vocabulary:
        """A vocabulary of these pieces, by score; ids 0 to 255 are the bytes, the pieces follow in order."""
        v = cls.__new__(cls)
        pieces = {p: (s, 256 + i) for i, (p, s) in enumerate(scores.items())}
        v._set(pieces, [bytes([b]) for b in range(256)] + [p.replace(BLANK, " ").encode() for p in pieces], list(range(256)))
        return v

    def _set(self, pieces: dict[str, tuple[float, int]], spelt: list[bytes], single: list[int]) -> None:
        self.scores, self.spelt, self.bytes = pieces, spelt, single
        self.longest = max(map(len, pieces), default=1)
        self.fallback = min((s for s, _ in pieces.values()), default=0.0) - 10
        children: dict = {}
        for piece in sorted(pieces, key=len, reverse=True):
            at = children
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = pieces[piece]
        self.trie = self._node(children)[0]

    def _node(self, children: dict) -> tuple[dict, float | None, int]:
        score, i = children.pop("", (None, -1))
        return {c: self._node(deeper) for c, deeper in children.items()}, score, i

    def fall_back(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The bytes of a text, without the blank put before it."""
        data = b"".join(map(self.spelt.__getitem__, ids))
        return data[1:] if data.startswith(b" ") else data


class StreamingViterbi:
    """Feed spelt text by parts of any size; each call gives the ids that became final. finish() gives the rest.

    Places count from the last final boundary on. Only starts whose longest piece lies within the text so far are gone on from.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.most = self.held = 0  # most scores and most backpointers held so far
        self._start()

    def _start(self) -> None:
        v = self.v
        self.text = ""
        self.at = 0  # the next start to go on from
        self.far = 0  # the furthest end reached
        self.low = 0  # the place of the first score held
        self.best = [0.0] + [LOWEST] * v.longest  # scores of the ends from `low` to at + longest
        self.back = [0] * (v.longest + 1)  # length of the best way's last piece at each end; negative: bytes

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        for i in range(0, len(part), CHUNK):
            self.text += part[i : i + CHUNK]
            out += self._go_on(self.v.longest - 1)
        return out

    def finish(self) -> list[int]:
        out = self._go_on(0)
        out += self._given(len(self.text))
        self._start()
        return out

    def _go_on(self, ahead: int) -> list[int]:
        """Go on from all starts but the last `ahead` ones."""
        out: list[int] = []
        while self.at < len(self.text) - ahead:
            self._reach(min(len(self.text) - ahead, self.at + self.v.longest))
            out += self._settle()
        return out

    def _reach(self, stop: int) -> None:
        """Extend the best ways from all starts before `stop` by one piece each."""
        text, best, back, low, far = self.text, self.best, self.back, self.low, self.far
        root, fallback, n = self.v.trie, self.v.fallback, len(self.text)
        for at in range(self.at, stop):
            base, end = best[at - low], at
            node, score, _ = root.get(text[at], NOWHERE)
            if score is None and base + fallback > best[at + 1 - low]:
                best[at + 1 - low], back[at + 1] = base + fallback, -1
            while True:
                end += 1
                if score is not None and base + score > best[end - low]:
                    best[end - low], back[end] = base + score, end - at
                    if end > far:
                        far = end
                if end == n or (got := node.get(text[end])) is None:
                    break
                node, score, _ = got
            if far == at:
                far = at + 1
            best.append(LOWEST)
            back.append(0)
        self.at, self.far = stop, far
        self.most, self.held = max(self.most, len(best)), max(self.held, len(back))

    def _settle(self) -> list[int]:
        """Let go of scores that no piece starts from any more; give out what lies before the boundary through which all open ends lead back."""
        del self.best[: self.at - self.low]
        self.low = self.at
        ends = {e for e in range(self.at, self.far + 1) if self.best[e - self.low] > LOWEST}
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(last - abs(self.back[last]))
        at = ends.pop()
        out = self._given(at) if at else []
        self.text, self.back = self.text[at:], self.back[at:]
        self.at, self.far, self.low = self.at - at, self.far - at, self.low - at
        return out

    def _given(self, end: int) -> list[int]:
        out: list[int] = []
        scores, text, back = self.v.scores, self.text, self.back
        while end:
            size = back[end]
            if size < 0:
                out += reversed(self.v.fall_back(text[end - 1]))
            else:
                out.append(scores[text[end - size : end]][1])
            end -= abs(size)
        return out[::-1]


def spelt(text: str) -> str:
    """A whole text as the normaliser spells it; an empty one stays empty."""
    return (BLANK + text).replace(" ", BLANK) if text else ""


def stream(v: Vocabulary, parts: Iterator[str]) -> Iterator[list[int]]:
    """Ids of a text that comes in parts, as they become final."""
    encoder, first = StreamingViterbi(v), True
    for part in parts:
        if part:
            yield encoder.feed((BLANK + part if first else part).replace(" ", BLANK))
            first = False
    yield encoder.finish()


class PieceIds(WordIds):
    """Ids of whole texts by units between the places where all paths converge: each goes through a streaming encoder; short ones are remembered."""

    def __init__(self, path: str, most: int = 1_200_000):
        self.v = Vocabulary(path)
        self.most = most
        self.encoder = StreamingViterbi(self.v)
        self.forget()

    def unit(self, unit: str) -> list[int]:
        out = self.encoder.feed(unit)
        return out + self.encoder.finish()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        # A line end is a unit; all others begin with their blank, or follow a line end.
        units = SPLIT.findall((BLANK + text).replace(" ", BLANK))
        long = [i for i, u in enumerate(units) if len(u) > REMEMBERED]
        if not long:
            return self.gathered(units)
        out, at = [], 0
        for i in long:
            out += [self.gathered(units[at:i]), np.array(self.unit(units[i]), np.uint32)]
            at = i + 1
        return np.concatenate([*out, self.gathered(units[at:])])
