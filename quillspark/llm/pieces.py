"""Unigram view of a SentencePiece vocabulary file: pieces, byte pieces and log-probabilities.

The file's scores give the pieces' order; a piece of score -r gets the
Zipf-Mandelbrot weight 1 / (r + SHIFT), normalised over all usable pieces.
Pieces with a word mark inside are left out, so that no piece spans the start
of a word. Nothing is trained. The table is as large as the vocabulary,
whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

SHIFT = 2.7
MARK = "▁"
MAX_PIECES = 1_000_000


@dataclass(frozen=True)
class Pieces:
    """``table`` maps a piece (word mark as a space) to (id, log-probability) and
    every proper prefix of one to None; ``spell`` gives the bytes of an id."""

    table: dict[str, tuple[int, float] | None]
    bytes_: tuple[tuple[int, float], ...]
    spell: tuple[bytes, ...]
    longest: int

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if n > MAX_PIECES:
            raise ValueError(f"{n} pieces; at most {MAX_PIECES} are sent to the executors")
        weights, spell, byte_ids = {}, [b""] * n, {}
        for i in range(n):
            if sp.is_byte(i):
                spell[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
                byte_ids[spell[i][0]] = i
                weights[i] = 1 / (n + SHIFT)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                spell[i] = piece.replace(MARK, " ").encode()
                if MARK not in piece[1:]:
                    weights[i] = 1 / (max(0.0, -sp.get_score(i)) + SHIFT)
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        total = sum(weights.values())
        # multiples of 2 ** -20 add up without rounding, so that equal paths tie wherever they stand
        return Pieces.of({i: round(log(w / total) * (1 << 20)) / (1 << 20) for i, w in weights.items()}, tuple(spell),
                         tuple(byte_ids[b] for b in range(256)))

    @staticmethod
    def of(logp: dict[int, float], spell: tuple[bytes, ...], byte_ids: tuple[int, ...]) -> Pieces:
        table: dict[str, tuple[int, float] | None] = {}
        own = set(byte_ids)
        for i, p in logp.items():
            if i not in own:
                piece = spell[i].decode()
                for k in range(1, len(piece)):
                    table.setdefault(piece[:k], None)
                table[piece] = (i, p)
        return Pieces(table, tuple((i, logp[i]) for i in byte_ids), spell, max(map(len, table)))

    def reweighted(self, logp: dict[int, float]) -> Pieces:
        return Pieces.of(logp, self.spell, tuple(i for i, _ in self.bytes_))

    def logps(self) -> dict[int, float]:
        return dict(v for v in self.table.values() if v) | dict(self.bytes_)

    def edges(self, text: str, at: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """Pieces that start at a position: (end, log-probability, ids). A character
        without a piece of its own is spelled in bytes."""
        out, table, single = [], self.table, False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            if part not in table:
                break
            got = table[part]
            if got:
                out.append((end, got[1], (got[0],)))
                single |= end == at + 1
        if not single:
            spelled = [self.bytes_[b] for b in text[at].encode("utf-8", "surrogatepass")]
            out.append((at + 1, sum(p for _, p in spelled), tuple(i for i, _ in spelled)))
        return out
