"""Personal data: plain patterns, and a character BiLSTM with CRF transitions trained in numpy.

The patterns give the base spans. The network reads every character of every text in overlapping
windows; each window is decoded by Viterbi, each character takes its tag from the window in which it
stands farthest from an edge, and runs of a tag become spans. A span that meets no base span is added
if its characters pass the exact check of its kind.
"""

from __future__ import annotations

import bisect
import io
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.llm.text import fit_in_one_task, map_slices, repeated_ranges

KINDS = ("email", "ip", "card", "phone")

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()),
]))

#: Texts of the table whose passages the network is trained on.
SAMPLE_TEXTS = 800

HIDDEN, EMBED, STEPS, BATCH, LENGTH = 12, 8, 450, 64, 80
WINDOW, OVERLAP, GROUP = 384, 48, 512

#: Steps whose states are weighed for the tags at once.
AT_ONCE = 32

LATIN, LETTER, OTHER, EDGE = 128, 129, 130, 131

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"\(?[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that do not overlap; a match that fails its check is dropped."""
    found, last = [], 0
    for m in DOMAIN.finditer(text):
        # every start inside the run before the sign would need this same sign and domain
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            last = m.end()
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def checked(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The exact borders of a decoded span, or None if its characters are not of the kind."""
    low, high = max(0, start - 6), min(len(text), end + 6)
    part = text[low:high]
    if kind == "email":
        hits = [(s, e) for k, s, e in base_spans(part) if k == "email"]
    elif kind == "ip":
        hits = [(s, e) for k, s, e in base_spans(part) if k == "ip"]
    elif kind == "card":
        hits = [m.span() for m in CARD.finditer(part) if is_card(m[0])]
        inner = text[start:end]
        if not hits and CARD.fullmatch(inner) and is_card(inner):
            hits = [(start - low, end - low)]
    else:
        hits = [
            m.span() for m in LOCAL_PHONE.finditer(part)
            if 9 <= len(digits_of(m[0])) <= 15 and re.search(r"[ ().-]", m[0])
        ]
    for s, e in hits:
        s, e = s + low, e + low
        if 2 * (min(e, end) - max(s, start)) >= max(e - s, end - start):
            return s, e
    return None


# ---- the network


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return classes_of(codes)


def classes_of(codes: np.ndarray) -> np.ndarray:
    kind = np.full(len(codes), OTHER, np.uint8)
    kind[codes < 0x2E80] = LETTER
    kind[codes < 0x250] = LATIN
    return np.where(codes < 128, codes, kind).astype(np.uint8)


def initial(seed: int = 17) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    tags = len(KINDS) + 1
    w = {"embed": rng.normal(0, 0.5, (132, EMBED))}
    for way in ("right", "left"):
        w[way] = rng.normal(0, 0.25, (4 * HIDDEN, EMBED + HIDDEN + 1))
        w[way][:, -1] = 0
        w[way][HIDDEN : 2 * HIDDEN, -1] = 1.5
    w["emit"] = rng.normal(0, 0.2, (tags, 2 * HIDDEN + 1))
    w["trans"] = np.zeros((tags, tags))  # from, to
    return {k: v.astype(np.float32) for k, v in w.items()}


#: From one kind straight to another is impossible; between two spans stands an outside character.
ALLOWED = np.eye(len(KINDS) + 1, dtype=bool)
ALLOWED[0, :] = ALLOWED[:, 0] = True


def emissions(w: dict, chars: np.ndarray, active: np.ndarray, memory: dict | None = None) -> np.ndarray:
    """Scores (T, tags, B) of each tag at each character; chars is (T, B).

    ``active[t]`` columns have a character at t (columns are sorted by length), the others rest at zero.
    Both directions are stepped together: the left one reads each column from its own end, so both have
    the same columns at a step. Gates, candidates and the cell's output are piecewise linear. The states
    of some steps at a time are weighed for the tags.
    """
    steps, width = chars.shape
    n = HIDDEN
    scaled = np.stack([w["right"], w["left"]])
    scaled[:, : 3 * n] *= 0.25
    scaled[:, : 3 * n, -1] += 0.5
    emit = np.ascontiguousarray(w["emit"][:, : 2 * n].reshape(-1, 2, n).transpose(1, 0, 2))
    table = np.ascontiguousarray(w["embed"].T)
    turned = reversed_columns(chars, active)
    joint = np.zeros((2, EMBED + n + 1, width), np.float32)
    joint[:, -1] = 1
    cell = np.zeros((2, n, width), np.float32)
    gates, fresh = np.empty((2, 4 * n, width), np.float32), np.empty((2, n, width), np.float32)
    score = np.empty((steps, 2, len(w["emit"]), width), np.float32)
    states = np.zeros((min(steps, AT_ONCE) if memory is None else steps, 2, n, width), np.float32)
    if memory is not None:
        memory.update(joint=[], gates=[], cell=[], before=[])
    for t in range(steps):
        a = int(active[t])
        full = a == width
        j, c, z, new = (joint, cell, gates, fresh) if full else (x[:, :, :a] for x in (joint, cell, gates, fresh))
        for k, source in enumerate((chars, turned)):
            if full:
                np.take(table, source[t], axis=1, out=j[k, :EMBED], mode="clip")
            else:
                j[k, :EMBED] = table[:, source[t, :a]]
        if memory is not None:
            memory["before"].append(cell.copy())
            memory["joint"].append(joint.copy())
        np.matmul(scaled, j, out=z)
        np.clip(z[:, : 3 * n], 0, 1, out=z[:, : 3 * n])
        np.clip(z[:, 3 * n :], -1, 1, out=z[:, 3 * n :])
        c *= z[:, n : 2 * n]
        np.multiply(z[:, :n], z[:, 3 * n :], out=new)
        c += new
        h = j[:, EMBED : EMBED + n]
        np.clip(c, -1, 1, out=h)
        h *= z[:, 2 * n : 3 * n]
        at = t % len(states)
        states[at, :, :, :a] = h
        if at + 1 == len(states) or t + 1 == steps:
            np.matmul(emit, states[: at + 1], out=score[t - at : t + 1])
        if memory is not None:
            memory["gates"].append(z.copy())
            memory["cell"].append(cell.copy())
    if memory is not None:
        memory["states"] = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)
    both = score[:, 0]
    both += reversed_columns(score[:, 1], active)
    both += w["emit"][:, -1:]
    return both


def reversed_columns(x: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Each column (last axis) turned round along the first axis within its own length; the rest as it was."""
    steps, width = len(x), x.shape[-1]
    if not steps or active[-1] == width:
        return x[::-1]
    length = (active[:, None] > np.arange(width)).sum(axis=0)
    time = np.arange(steps)[:, None]
    from_ = np.where(time < length, length - 1 - time, time)
    return np.take_along_axis(x, from_.reshape(steps, *[1] * (x.ndim - 2), width), axis=0)


def viterbi(score: np.ndarray, trans: np.ndarray, active: np.ndarray) -> np.ndarray:
    """The best tag sequence (T, B) under the allowed transitions.

    Columns in which no tag at any character can make up for the step into it are outside everywhere.
    The best score is found for the others, and the way back is walked where it beats the sequence that
    is outside everywhere.
    """
    outside, enter, stay, leave = trans[0, 0], trans[0, 1:], np.diag(trans)[1:], trans[1:, 0]
    back = max(0.0, float((leave - outside).max()))
    # the most that transitions add at an inside character, the way back out included
    most = np.maximum(np.maximum(enter - outside, 0) + back, stay - outside)
    path = np.zeros((score.shape[0], score.shape[2]), np.uint8)
    rest = (score[:, 1:] + (most + np.float32(1e-3))[:, None]).max(axis=1) > score[:, 0]
    rest &= np.arange(score.shape[2]) < active[:, None]
    columns = np.flatnonzero(rest.any(axis=0))
    columns = columns[beats_outside(score[:, :, columns], trans, np.searchsorted(columns, active))]
    if len(columns):
        path[:, columns] = walked_back(score[:, :, columns], trans, np.searchsorted(columns, active))
    return path


def beats_outside(score: np.ndarray, trans: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Which columns have a better sequence than the one that is outside everywhere."""
    stay, enter, leave = np.diag(trans)[1:, None], trans[0, 1:, None], trans[1:, 0, None]
    best, outside = score[0].copy(), score[0, 0].copy()
    for t in range(1, len(score)):
        a = int(active[t])
        b = best[:, :a]
        inside = np.maximum(b[1:] + stay, b[0] + enter)
        b[0] = np.maximum(b[0] + trans[0, 0], (b[1:] + leave).max(axis=0))
        b[1:] = inside
        b += score[t, :, :a]
        outside[:a] += trans[0, 0]
        outside[:a] += score[t, 0, :a]
    # both sums add the same numbers in the same order where the outside sequence is the best one
    return best.max(axis=0) != outside


def walked_back(score: np.ndarray, trans: np.ndarray, active: np.ndarray) -> np.ndarray:
    steps, tags, width = score.shape
    blocked = np.where(ALLOWED, trans, np.float32(-1e6))[:, :, None]
    best = score[0].copy()
    origin = np.empty((steps, tags, width), np.uint8)
    origin[:] = np.arange(tags, dtype=np.uint8)[:, None]
    for t in range(1, steps):
        a = int(active[t])
        ways = best[:, None, :a] + blocked
        origin[t, :, :a] = ways.argmax(axis=0)
        best[:, :a] = ways.max(axis=0) + score[t, :, :a]
    path = np.zeros((steps, width), np.uint8)
    path[-1] = best.argmax(axis=0)
    everyone = np.arange(width)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = origin[t, path[t], everyone]
    return np.where(np.arange(width) < active[:, None], path, 0)


def tags_of(w: dict, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A tag for each character of texts that lie side by side."""
    step = WINDOW - OVERLAP
    sizes = np.diff(offsets)
    counts = np.where(sizes == 0, 0, np.maximum(1, -(-(sizes - OVERLAP) // step)))
    owner, place = repeated_ranges(counts)
    begin = offsets[owner] + place * step
    length = np.minimum(begin + WINDOW, offsets[owner + 1]) - begin
    # the part of a window that it decides: up to the middle of each overlap
    low = begin + np.where(place > 0, OVERLAP // 2, 0)
    high = np.where(place + 1 < counts[owner], begin + WINDOW - OVERLAP // 2, begin + length)
    kind = np.append(classes_of(codes), np.uint8(EDGE)).astype(np.intp)
    tags = np.zeros(len(codes), np.uint8)
    # equal windows are decoded once
    raw = kind[:-1].astype(np.uint8).tobytes()
    seen: dict[bytes, int] = {}
    same = np.array([seen.setdefault(raw[b : b + n], i) for i, (b, n) in enumerate(zip(begin.tolist(), length.tolist()))], np.int64)
    firsts = np.flatnonzero(same == np.arange(len(same)))
    order = firsts[np.argsort(-length[firsts], kind="stable")]
    members = np.argsort(same, kind="stable")
    bounds = np.searchsorted(same[members], [order, order + 1]) if len(order) else np.zeros((2, 0), np.int64)
    for at in range(0, len(order), GROUP):
        pick = order[at : at + GROUP]
        steps = int(length[pick[0]])
        time = np.arange(steps)[:, None]
        spot = np.where(time < length[pick], begin[pick] + time, len(codes))
        active = (time < length[pick]).sum(axis=1)
        path = viterbi(emissions(w, kind[spot], active), w["trans"], active)
        tagged = np.flatnonzero(path.any(axis=0))
        low_at, high_at = bounds[:, at : at + GROUP][:, tagged]
        column, place = repeated_ranges(high_at - low_at)
        window = members[low_at[column] + place]
        hit, which = np.nonzero(path[:, tagged[column]])
        where = begin[window[which]] + hit
        mine = (where >= low[window[which]]) & (where < high[window[which]])
        tags[where[mine]] = path[hit[mine], tagged[column[which[mine]]]]
    return tags


# ---- training


def crf_gradients(score: np.ndarray, trans: np.ndarray, gold: np.ndarray):
    """Gradients of the mean negative log-likelihood to scores and transitions; all columns full."""
    steps, tags, width = score.shape
    blocked = np.where(ALLOWED, trans, -1e4)[:, :, None]

    def summed(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    ahead = np.empty_like(score)
    ahead[0] = score[0]
    for t in range(1, steps):
        ahead[t] = summed(ahead[t - 1][:, None] + blocked, 0) + score[t]
    after = np.zeros_like(score)
    for t in range(steps - 2, -1, -1):
        after[t] = summed(blocked + (score[t + 1] + after[t + 1])[None], 1)
    whole = summed(ahead[-1], 0)
    share = np.exp(ahead + after - whole)
    d_score = share.copy()
    np.put_along_axis(d_score, gold[:, None], np.take_along_axis(d_score, gold[:, None], 1) - 1, 1)
    pairs = ahead[:-1, :, None] + blocked[None] + (score[1:] + after[1:])[:, None] - whole
    d_trans = np.exp(pairs).sum(axis=(0, 3))
    np.add.at(d_trans, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    return d_score / width, np.where(ALLOWED, d_trans, 0).astype(np.float32) / width


def back_way(matrix: np.ndarray, memory: dict, way: int, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Back-propagation through one direction, in its own order: gradients of the matrix and the inputs."""
    n = HIDDEN
    d_matrix = np.zeros_like(matrix)
    d_inputs = np.zeros((d_out.shape[0], EMBED, d_out.shape[2]), np.float32)
    d_h = np.zeros((n, d_out.shape[2]), np.float32)
    d_c = np.zeros_like(d_h)
    for t in range(len(d_out) - 1, -1, -1):
        z, joint, cell, before = (memory[x][t][way] for x in ("gates", "joint", "cell", "before"))
        i, f, o, g = z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[3 * n :]
        bent = np.clip(cell, -1, 1)
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (np.abs(cell) < 1)
        d_z = np.concatenate([d_c * g, d_c * before, d_h * bent, d_c * i * (np.abs(g) < 1)])
        open_ = (z[: 3 * n] > 0) & (z[: 3 * n] < 1)
        d_z[: 3 * n] *= 0.25 * open_
        d_matrix += d_z @ joint.T
        d_joint = matrix.T @ d_z
        d_inputs[t] = d_joint[:EMBED]
        d_h = d_joint[EMBED : EMBED + n]
        d_c = d_c * f
    return d_matrix, d_inputs


def gradients(w: dict, chars: np.ndarray, gold: np.ndarray) -> dict:
    steps, width = chars.shape
    memory: dict = {}
    score = emissions(w, chars, np.full(steps, width), memory)
    d_score, d_trans = crf_gradients(score, w["trans"], gold)
    d_score = d_score.astype(np.float32)
    states, n = memory["states"], HIDDEN
    grads = {"trans": d_trans, "emit": np.zeros_like(w["emit"])}
    grads["emit"][:, :-1] = np.einsum("tkb,thb->kh", d_score, states)
    grads["emit"][:, -1] = d_score.sum(axis=(0, 2))
    d_states = np.matmul(w["emit"][:, :-1].T, d_score)
    grads["right"], d_in = back_way(w["right"], memory, 0, d_states[:, :n])
    grads["left"], more = back_way(w["left"], memory, 1, d_states[::-1, n:])
    d_in = d_in + more[::-1]
    grads["embed"] = np.zeros_like(w["embed"])
    np.add.at(grads["embed"], chars.ravel(), d_in.transpose(0, 2, 1).reshape(-1, EMBED))
    return grads


class Examples:
    """Labelled windows: passages of the sample with the spans that the patterns find there, and
    passages into which personal data, or numbers and names that are none, are written."""

    def __init__(self, texts: list[str], seed: int = 23):
        self.rng = random.Random(seed)
        self.texts = [t for t in texts if t.strip()] or ["a plain line of words to write into"]
        self.found = [(t, s) for t in self.texts for s in base_spans(t)]

    def number(self, digits: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(digits))

    def letters(self, low: int, high: int, also: str = "") -> str:
        return "".join(self.rng.choice("abcdefghijklmnopqrstuvwxyz" + also) for _ in range(self.rng.randint(low, high)))

    def email(self) -> str:
        r = self.rng
        local = self.letters(1, 9, "0123") + r.choice(["", "", ".", "_", "-", "+"]) + self.letters(1, 7, "0123456789")
        return local + "@" + ".".join(self.letters(2, 9) for _ in range(r.randint(1, 2))) + "." + self.letters(2, 4)

    def ip(self) -> str:
        return ".".join(str(self.rng.randint(0, 255)) for _ in range(4))

    def card(self) -> str:
        r = self.rng
        body = self.number(r.choice([12, 14, 15, 15, 15, 15, 18]))
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        return r.choice(["", "", " ", "-"]).join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def phone(self) -> str:
        r = self.rng
        area, mid, last, country = self.number(3), self.number(3), self.number(4), str(r.randint(1, 99))
        return r.choice([
            f"+{country} ({area}) {mid}-{last}", f"+{country} {area} {mid} {last}", f"+{country}-{area}-{mid}-{last}",
            f"+{country}{area}{mid}{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"({area}) {mid} {last}",
            f"{area}.{mid}.{last}", f"0{area} {mid}{last}", f"0{self.number(2)} {mid} {self.number(2)} {self.number(2)}",
        ])

    def harmless(self) -> str:
        r = self.rng
        day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(1900, 2040)
        return r.choice([
            f"{year}-{month:02}-{day:02}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{day:02}:{month:02}:{day:02}",
            f"{year}-{month:02}-{day:02} {day:02}:{month:02}:00", f"{day}.{month}", f"{day}.{month}.{r.randint(0, 30)}",
            f"{self.number(r.randint(1, 3))},{self.number(3)}.{self.number(2)}", f"{year}-{year + 3}", str(year),
            self.number(r.randint(1, 9)), self.letters(3, 8) + self.number(r.randint(1, 6)), f"{day}%", f"+{day}",
            "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 18, 32, 40]))),
            "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(r.randint(12, 20))),
            f"978-{self.number(1)}-{self.number(4)}-{self.number(4)}-{self.number(1)}", f"({day}) {year}",
            f"{self.number(2)} {self.number(3)} {self.number(3)}", f"@{self.letters(3, 9)}", f"{self.letters(2, 6)}@",
            f"{year}, {year + 1}, {year + 2}, {year + 4}", f"{day} - {month} - {year % 100}", f"#{self.number(6)}",
        ])

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        r = self.rng
        dice = r.random()
        if dice < 0.15 and self.found:
            text, (_, start, _) = r.choice(self.found)
            spans = [s for t, s in self.found if t is text]
            at = max(0, start - r.randint(0, LENGTH))
        else:
            text = r.choice(self.texts)
            at = r.randrange(max(1, len(text) - LENGTH // 2))
            spans = []
            piece = text[at : at + LENGTH]
            if dice < 0.9:
                built, spans, low = "", [], 0
                for cut in sorted(r.randrange(len(piece) + 1) for _ in range(r.randint(1, 2))):
                    built += piece[low:cut]
                    low = cut
                    kind = r.choice(KINDS) if r.random() < 0.62 else None
                    made = getattr(self, kind)() if kind else self.harmless()
                    before, behind = r.choice([(" ", " "), (" ", " "), (" ", ". "), (": ", ", "), ("", "\n"), (" (", ") ")])
                    built += before
                    if kind:
                        spans.append((kind, len(built), len(built) + len(made)))
                    built += made + behind
                text, at = built + piece[low:], 0
                at = r.randint(0, max(0, len(text) - LENGTH))
            else:
                spans = base_spans(text)
        gold = np.zeros(len(text), np.intp)
        for kind, s, e in spans:
            gold[s:e] = KINDS.index(kind) + 1
        chars = np.full(LENGTH, EDGE, np.intp)
        tags = np.zeros(LENGTH, np.intp)
        piece = classes(text[at : at + LENGTH])
        chars[: len(piece)] = piece
        tags[: len(piece)] = gold[at : at + LENGTH]
        return chars, tags


def fit(rows: list[dict]) -> bytes:
    w, examples = initial(), Examples([r["text"] or "" for r in rows])
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, STEPS + 1):
        windows = [examples.window() for _ in range(BATCH)]
        chars = np.stack([c for c, _ in windows], axis=1)
        gold = np.stack([g for _, g in windows], axis=1)
        grads = gradients(w, chars, gold)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * (1 - 0.95 * step / STEPS)
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            scale = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
            w[k] -= (rate * first[k] / (1 - 0.9**step) / scale).astype(np.float32)
    out = io.BytesIO()
    np.savez_compressed(out, **w)
    return out.getvalue()


def unpack(model: bytes) -> dict[str, np.ndarray]:
    parts = np.load(io.BytesIO(model))
    return {k: parts[k] for k in parts.files}


def train(documents: DataFrame, texts: int = SAMPLE_TEXTS) -> bytes:
    """Fit on windows of at most ``texts`` texts, chosen by a hash of doc_id."""
    ids = documents.select(F.col("doc_id").alias("id")).filter("id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("id", F.lit(31)), "id").limit(texts)
    found = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    found = found.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))
    return fit_in_one_task(found, fit)


# ---- the operator


def spans_of(text: str, tags: np.ndarray) -> list[dict]:
    """Base spans and added ones, by kind, then by start."""
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "base": True} for k, s, e in base]
    if tags.any():
        begins, ends = joined_spans(base)
        last = 0  # end of the span that was added last: added spans follow one another

        def is_free(s: int, e: int) -> bool:
            i = bisect.bisect_right(ends, s)
            return s >= last and (i == len(ends) or begins[i] >= e)

        edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if not tags[start] or not is_free(start, end):
                continue
            kind = KINDS[tags[start] - 1]
            exact = checked(kind, text, start, end)
            if exact and is_free(*exact):
                last = exact[1]
                out.append({"kind": kind, "start": exact[0], "end": exact[1], "base": False})
    return sorted(out, key=lambda x: (KINDS.index(x["kind"]), x["start"]))


def joined_spans(base: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the stretches that spans cover, in order; spans that overlap are one."""
    begins, ends = [], []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)
    return begins, ends


def decoded(buf: np.ndarray, offsets: np.ndarray, w: dict) -> Iterator[tuple[str, list[dict]]]:
    """The texts of a slice with their spans."""
    raw, cut = buf.tobytes(), offsets.tolist()
    texts = [raw[a:b].decode(errors="replace") for a, b in zip(cut, cut[1:])]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    tags = tags_of(w, codes, ends)
    for t, a, b in zip(texts, ends, ends[1:]):
        yield t, spans_of(t, tags[a:b])


def without_spans(text: str, spans: list[dict]) -> str | None:
    """The text with each span replaced by its kind in brackets, spans that overlap by the first of
    them; None if there is no span."""
    parts, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]]) if spans else None


def find_spans(documents: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """``spans`` of each whole text: kind, start, end (code points, end exclusive), base.

    NULL and empty texts have none. The model has a fixed size.
    """
    def work(buf, offsets, w, part):
        return [pa.array([spans for _, spans in decoded(buf, offsets, w)], ARROW_SPANS)]

    return map_slices(
        documents, "text", keep or ["doc_id"], work, [T.StructField("spans", SPANS)], prepare=lambda: unpack(model))


ARROW_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, and all spans as text.

    Repeated rows give the same spans and are each kept; other columns are dropped.
    """
    found = find_spans(documents, train(documents))
    base = F.filter("spans", lambda s: s.base)
    kinds = F.transform(base, lambda s: s.kind)
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, and ``n_chars`` counted again.

    Spans that overlap are replaced as one. NULL texts stay NULL; all columns are kept.
    """
    model = train(documents)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    packed = documents.select(row.alias("row"), F.col("text").cast("string").alias("text"))

    def work(buf, offsets, w, part):
        return [pa.array([without_spans(t, spans) for t, spans in decoded(buf, offsets, w)], pa.string())]

    found = map_slices(
        packed, "text", ["row"], work, [T.StructField("clean", T.StringType())], prepare=lambda: unpack(model))
    columns = []
    for c in documents.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.coalesce("clean", value)
        elif c == "n_chars":
            value = F.coalesce(F.length("clean").cast(documents.schema[c].dataType), value)
        columns.append(value.alias(c))
    return found.select(*columns)
