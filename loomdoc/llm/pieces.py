"""SentencePiece encoding and decoding.

Pieces and scores are read from a model file. An Aho-Corasick automaton over the pieces runs once through the text; at each
position the matches that its output links give relax the best score of a segmentation ending there (Viterbi in a single
pass), and the best path is read backwards. Characters that no piece covers are written as byte pieces (or the unknown
piece, if the model has none).

A text is cut first at places that no piece spans (before a space mark that follows another character, checked against the
vocabulary), so the best path of the whole is the best paths of its parts, and those of frequent parts are kept.

Cases: null text counts as empty and has no pieces; a text that holds the space mark itself (U+2581) decodes to a space there,
as the format defines; ties go to the longer last piece. Repeated rows stay apart; other columns are not used.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"
#: Score of a character without a piece, below the lowest piece score.
UNKNOWN = 10.0
#: Parts kept with their pieces, and the longest part that is kept.
KEPT, LONGEST = 50_000, 32
NEVER = float("-inf")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Table:
    """The automaton of the pieces that ASCII and Latin characters spell, as arrays: for many short parts at once."""

    CHARACTERS = [MARK, *map(chr, range(33, 127)), *map(chr, range(0xA1, 0x17F))]

    def __init__(self, model: Pieces) -> None:
        code = {c: k for k, c in enumerate(self.CHARACTERS) if c in model.single}
        code = {c: k for k, c in enumerate(code)}
        self.low, width = model.lowest, len(code)
        self.code = np.full(0x2583, -1, dtype=np.int16)
        for c, k in code.items():
            self.code[ord(c)] = k
        children: list[dict[int, int]] = [{}]
        piece, length, score = [-1], [0], [0.0]
        for i, (q, kind) in enumerate(zip(model.pieces, model.kinds)):
            if kind != "normal" or not q or not all(c in code for c in q):
                continue
            at = 0
            for depth, c in enumerate(q, 1):
                to = children[at].get(code[c])
                if to is None:
                    to = children[at][code[c]] = len(children)
                    children.append({})
                    piece.append(-1)
                    length.append(depth)
                    score.append(0.0)
                at = to
            piece[at], score[at] = i, model.scores[i]
        n = len(children)
        self.step = np.zeros((n, width), dtype=np.int32)
        #: The nearest suffix that is a piece: the output link.
        self.link, fail = np.zeros(n, dtype=np.int32), [0] * n
        queue = deque(children[0].values())
        for c, to in children[0].items():
            self.step[0, c] = to
        while queue:
            at = queue.popleft()
            back = fail[at]
            self.link[at] = back if piece[back] >= 0 else self.link[back]
            self.step[at] = self.step[back]
            for c, to in children[at].items():
                fail[to] = int(self.step[back, c])
                self.step[at, c] = to
                queue.append(to)
        self.piece, self.length, self.score = np.array(piece, np.int32), np.array(length, np.int32), np.array(score)

    def best_paths(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts in one array, where each part's start, and how many there are: -1 where a part holds other
        characters or is too long."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts, sizes = np.zeros(len(parts), np.int64), np.full(len(parts), -1)
        sizes[lengths == 0] = 0
        order = np.argsort(lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= LONGEST)]
        flat, total = [np.zeros(0, np.int32)], 0
        for at in range(0, len(order), 8192):
            chosen = order[at : at + 8192]
            own = lengths[chosen]
            most = int(own.max())
            joined = "".join([parts[i].ljust(most, MARK) for i in chosen.tolist()])
            text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, most)
            codes = self.code[np.minimum(text, len(self.code) - 1)]
            fit = (codes >= 0).all(axis=1)
            if not fit.all():
                chosen, own, codes = chosen[fit], own[fit], codes[fit]
            if not len(chosen):
                continue
            ids, count = self._together(np.ascontiguousarray(codes.T), own)
            starts[chosen], sizes[chosen] = total + np.cumsum(count) - count, count
            flat.append(ids)
            total += len(ids)
        return np.concatenate(flat), starts, sizes

    def _together(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In step: all parts advance by a character, then follow the output links of their states."""
        most, n = codes.shape
        best = np.full((most + 1, n), NEVER)
        came = np.zeros((most + 1, n), dtype=np.int32)  # the state of the last piece
        best[0] = 0.0
        flat, state, every = best.ravel(), np.zeros(n, dtype=np.int32), np.arange(n)
        for t in range(most):
            state = self.step[state, codes[t]]
            here, own, back = state, best[t + 1], came[t + 1]
            rows = every
            miss = self.piece[here] < 0
            here = np.where(miss, self.link[here], here)
            while True:
                value = flat[(t + 1 - self.length[here]) * n + rows] + self.score[here]
                if len(rows) == n:
                    better = value > own
                    own[better], back[better] = value[better], here[better]
                else:
                    better = value > own[rows]
                    chosen = rows[better]
                    own[chosen], back[chosen] = value[better], here[better]
                here = self.link[here]
                live = here > 0
                if not live.any():
                    break
                if not live.all():
                    rows, here = rows[live], here[live]
        found = np.zeros((most, n), dtype=np.int32)
        at, count = sizes.copy(), np.zeros(n, dtype=np.int64)
        live = np.flatnonzero(at > 0)
        while len(live):
            s = came[at[live], live]
            found[most - 1 - count[live], live] = self.piece[s]
            count[live] += 1
            at[live] -= self.length[s]
            live = live[at[live] > 0]
        return np.ascontiguousarray(found.T)[np.arange(most)[None, :] >= (most - count)[:, None]], count


class Pieces:
    """Encoder and decoder over pieces, scores and kinds (``normal``, ``control``, ``unknown``, ``byte``)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], dummy_prefix: bool = True) -> None:
        self.pieces, self.scores, self.kinds, self.dummy_prefix = pieces, scores, kinds, dummy_prefix
        self.unknown = kinds.index("unknown") if "unknown" in kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == "byte"}
        self.byte_of = {i: v for v, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        normal = [i for i, k in enumerate(kinds) if k == "normal" and pieces[i]]
        for i in normal:
            self.automaton.add_word(pieces[i], (len(pieces[i]), scores[i], i))
        self.single = {pieces[i] for i in normal if len(pieces[i]) == 1}
        self.pieces_known = bool(normal)
        if normal:
            self.automaton.make_automaton()
        self.lowest = min((scores[i] for i in normal), default=0.0) - UNKNOWN
        self.parts, self.signs = self.cutting([pieces[i] for i in normal])
        self.kept: dict[str, tuple[int, ...]] = {}
        self.own_table: Table | None = None
        #: What a piece decodes to; None for bytes beyond ASCII, which decode together.
        self.surface = [{"normal": q, "unknown": " ⁇ ", "control": ""}.get(k, chr(self.byte_of[i]) if self.byte_of.get(i, 255) < 128 else None) for i, (q, k) in enumerate(zip(pieces, kinds))]
        self.high = {i for i, x in enumerate(self.surface) if x is None}

    @staticmethod
    def cutting(normal: list[str]) -> tuple[re.Pattern | None, re.Pattern | None]:
        """Parts of a text between places that no piece spans: before a space mark that follows another character, and before a
        sign that in no piece follows a character other than such signs. None if pieces span space marks."""
        pairs = {x for q in normal for x in zip(q, q[1:])}
        if any(b == MARK != a for a, b in pairs):
            return None, None
        signs = {c for q in normal for c in q if c < "\x80" and not c.isalnum()} | set("\n\t")
        while rest := {b for a, b in pairs if b in signs and a not in signs and a != MARK}:
            signs -= rest
        own = "".join(map(re.escape, sorted(signs - {" "})))
        return re.compile(f" *[^ {own}]+| *[{own}][^ ]*| +" if own else " *[^ ]+| +"), re.compile(f"[{own}]" if own else r"(?!)")

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        kind = lambda i: "byte" if p.is_byte(i) else "unknown" if p.is_unknown(i) else "control" if p.is_control(i) or p.is_unused(i) else "normal"
        return cls([p.id_to_piece(i) for i in ids], [p.get_score(i) for i in ids], [kind(i) for i in ids])

    def best_path(self, part: str) -> tuple[int, ...]:
        """Piece ids of the segmentation of ``part`` (with space marks) with the highest sum of scores."""
        n, low = len(part), self.lowest
        best, came = [0.0] + [NEVER] * n, [None] * (n + 1)
        if self.single.issuperset(part):  # each position is reached by a piece
            for end, (length, score, piece) in self.automaton.iter(part):
                score += best[end + 1 - length]
                if score > best[end + 1]:
                    best[end + 1], came[end + 1] = score, (length, piece)
        else:
            done = 0  # positions up to here are final: the automaton gives matches by their end
            for end, (length, score, piece) in self.automaton.iter(part) if self.pieces_known else ():
                while done < end:
                    done += 1
                    if best[done] < best[done - 1] + low:
                        best[done], came[done] = best[done - 1] + low, None
                score += best[end + 1 - length]
                if score > best[end + 1]:
                    best[end + 1], came[end + 1] = score, (length, piece)
            while done < n:
                done += 1
                if best[done] < best[done - 1] + low:
                    best[done], came[done] = best[done - 1] + low, None
        out, at = [], n
        while at:
            if came[at] is None:
                at -= 1
                data = part[at].encode("utf-8", "surrogatepass")
                out += [self.bytes[v] for v in reversed(data)] if len(self.bytes) == 256 else [self.unknown]
            else:
                length, piece = came[at]
                out.append(piece)
                at -= length
        return tuple(reversed(out))

    def table(self) -> Table:
        if self.own_table is None:
            self.own_table = Table(self)
        return self.own_table

    def irregular(self, text: str) -> np.ndarray:
        """Part by part; frequent parts are kept."""
        if self.parts is None:
            return np.array(self.best_path(text.replace(" ", MARK)), np.int32)
        out: list[int] = []
        for part in self.parts.findall(text):
            ids = self.kept.get(part)
            if ids is None:
                ids = self.best_path(part.replace(" ", MARK))
                if len(part) <= LONGEST:
                    if len(self.kept) >= KEPT:
                        self.kept.clear()
                    self.kept[part] = ids
            out += ids
        return np.array(out, np.int32)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in one array, and how many each text has. The words of all texts are told apart and encoded
        once, and a text's ids are gathered from those of its words."""
        plain = self.dummy_prefix and self.parts is not None and self.signs.search("\n")
        odd = re.compile(f"^ |  | \n|\n |[{MARK}\x01]| $")
        regular = [k for k, t in enumerate(texts) if plain and t and not odd.search(t)]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for k in set(range(len(texts))).difference(regular):
            if texts[k]:
                text = texts[k].replace(MARK, " ")
                out[k] = self.irregular(" " + text if self.dummy_prefix else text)
        if regular:
            # a line break is a word of its own, and \x01 stands before a word that has no space before it
            words = pa.compute.split_pattern(pa.array([texts[k].replace("\n", " \n \x01") for k in regular], pa.string()), " ")
            coded = words.values.dictionary_encode()
            own = [w[1:] if w[:1] == "\x01" else "\n" if w == "\n" else MARK + w for w in coded.dictionary.to_pylist()]
            flat, starts, sizes = self.table().best_paths(own)
            rest, total = [flat], len(flat)
            for i in np.flatnonzero(sizes < 0).tolist():
                ids = self.irregular(own[i].replace(MARK, " "))
                starts[i], sizes[i] = total, len(ids)
                total += len(ids)
                rest.append(ids)
            flat, codes = np.concatenate(rest), coded.indices.to_numpy()
            counts = sizes[codes]
            ends = np.cumsum(counts)
            ids = flat[np.repeat(starts[codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()]
            for k, a, b in zip(regular, bounds[:-1].tolist(), bounds[1:].tolist()):
                out[k] = ids[a:b]
        return np.concatenate([np.zeros(0, np.int32), *out]), np.array([len(x) for x in out], dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            text = "".join([self.surface[i] for i in ids])
        else:
            data = b"".join([bytes([self.byte_of[i]]) if i in self.high else self.surface[i].encode("utf-8", "surrogatepass") for i in ids])
            try:
                text = data.decode("utf-8", "surrogatepass")
            except UnicodeDecodeError:
                text = data.decode("utf-8", "replace")
        if self.dummy_prefix and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces.load(path)
    return _loaded[path]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, n_chars, n_pieces, piece_ids``: each whole text's pieces. No shuffle; ``model`` is a path that tasks can read."""
    model = model or default_model()
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("piece_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(model)
        for b in slices(batches, 5_000_000):
            own = [t or "" for t in b.column(1).to_pylist()]
            flat, sizes = p.encode_all(own)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in own], pa.int64()), pa.array(sizes, pa.int64()), lists], schema=schema)

    return documents.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id bigint, n_chars bigint, n_pieces bigint, piece_ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds ``decoded`` to rows with ``doc_id, n_chars, n_pieces, piece_ids``."""
    model = model or default_model()
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("piece_ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                lists = b.column(3)
                flat, ends = lists.flatten().to_pylist() if lists.null_count else lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].tolist(), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist()
                out, at = [], 0
                for n in ends:
                    out.append(p.decode(flat[at : at + n]))
                    at += n
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], schema=schema)

    return encoded.select("doc_id", "n_chars", "n_pieces", "piece_ids").mapInArrow(run, "doc_id bigint, n_chars bigint, n_pieces bigint, piece_ids array<int>, decoded string")
