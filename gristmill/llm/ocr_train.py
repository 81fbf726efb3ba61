"""Trains the models of the page repair on made-up noise: python -m gristmill.llm.ocr_train"""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np

from gristmill.llm import ocr, pii_table
from gristmill.llm.language import COMMON


def vocabulary(r: random.Random) -> dict[str, int]:
    """Words of the package's own tables with made-up counts."""
    words: set[str] = set()
    for text in [*COMMON.values(), *pii_table.LINES.values()]:
        words |= {w.lower() for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\{\w+\}|<\w+>", " ", text))}
    out = {w: int(10 ** r.uniform(0.5, 4.5)) for w in sorted(words)}
    for _ in range(400):
        out[pii_table._word(r, pii_table._BRAND_HEADS, pii_table._BRAND_MIDS, pii_table._BRAND_TAILS).lower()] = int(10 ** r.uniform(0.3, 2))
    return out


def misread(w: str, r: random.Random, times: int = 1) -> str | None:
    """The word with some of its letters misread, each once, or none if none of them can be."""
    places = [(m.start(), a, b) for a, bs in ocr.MISREAD.items() for b in bs for m in re.finditer(re.escape(a), w)]
    r.shuffle(places)
    taken: list[tuple[int, str, str]] = []
    for i, a, b in places:
        if len(taken) < times and all(i + len(a) <= j or j + len(c) <= i for j, c, _ in taken):
            taken.append((i, a, b))
    for i, a, b in sorted(taken, reverse=True):
        w = w[:i] + b + w[i + len(a) :]
    return w.lower() if taken else None


def rank_rows(r: random.Random, missed: list[tuple[str, str]] | None = None):
    """missed: gets (right, seen) of each misreading whose lookup lacks its right word."""
    v = vocabulary(r)
    often = [0] * ocr.BUCKETS
    for w in v:
        for g in ocr._grams(w, ocr._q(len(ocr.alike(w)))):
            often[ocr._bucket(g)] += 1
    keys = ocr.Grams(often)
    by: dict[str, list[str]] = {}
    for w in v:
        for k in keys.right(w):
            by.setdefault(k, []).append(w)

    def near(s):
        return {w for k in keys.seen(s) for w in by.get(k, ()) if w != s and ocr.may_be(w, s) and ocr.distance(w, s) <= 1.3}

    x, y = [], []
    for w, n in v.items():
        for _ in range(6):
            s = misread(w, r, r.choice([1, 1, 1, 2, 3]) if len(w) > 5 else 1)
            if s is None or s in v or n < 3:
                continue
            seen = max(1, int(n * 10 ** r.uniform(-3.3, -1.2)))
            found = near(s)
            if missed is not None and w not in found:
                missed.append((w, s))
            for c in found:
                x.append(ocr.rank_features(s, c, r.choice([0, 0, 0, seen // 40]), seen, v[c], int(v[c] * r.uniform(0.1, 0.6))))
                y.append(float(c == w))
        # right words that pages alone have: pieces of words, rare names, headings
        for s in (w[: r.randint(2, max(2, len(w) - 1))], w[r.randint(0, max(0, len(w) - 2)) :], pii_table._word(r, pii_table._BRAND_HEADS, pii_table._BRAND_MIDS, pii_table._BRAND_TAILS).lower(), w + r.choice("senr"), w[:-1] + r.choice("aeionstr")):
            if s in v or len(s) < 2:
                continue
            seen = int(10 ** r.uniform(0, 2.5))
            for c in near(s):
                x.append(ocr.rank_features(s, c, 0, seen, v[c], int(v[c] * r.uniform(0.1, 0.6))))
                y.append(0.0)
    return np.array(x), np.array(y)


def boost(x, y, trees=70, rate=0.2, bins=24):
    """Logistic boosting with trees of depth 3 over quantile cuts."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, at, leaf = [0] * 7, [np.inf] * 7, [0.0] * 8
        node = np.zeros(len(y), np.int64)
        for k in range(7):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf)
            gs, hs = g[rows].sum(), h[rows].sum()
            for f in range(x.shape[1]) if len(rows) > 20 else ():
                for c in cuts[f]:
                    right = x[rows, f] > c
                    gr, hr = g[rows][right].sum(), h[rows][right].sum()
                    gain = gr * gr / (hr + 1) + (gs - gr) ** 2 / (hs - hr + 1) - gs * gs / (hs + 1)
                    if gain > best[0]:
                        best = (gain, f, float(c))
            feature[k], at[k] = best[1], best[2]
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > at[k])
        for j in range(8):
            rows = node == 7 + j
            leaf[j] = float(rate * g[rows].sum() / (h[rows].sum() + 1))
        score += np.array(leaf)[node - 7]
        out.append({"feature": feature, "at": [min(a, 1e9) for a in at], "leaf": leaf})
    return out, base


def softmax_fit(x, y, classes, steps=1500, rate=0.5, l2=1e-4):
    w = np.zeros((classes, x.shape[1]))
    goal = np.eye(classes)[y]
    for _ in range(steps):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * ((p - goal).T @ x / len(x) + l2 * w)
    return w


def cut_rows(r: random.Random):
    v = vocabulary(r)
    words = [w for w in v if len(w) > 4]
    x, y = [], []
    for _ in range(6000):
        w = r.choice(words)
        i = r.randint(2, len(w) - 2)
        a, b, soft = w[:i], w[i:], r.random() < 0.45
        known = r.random() < 0.85
        x.append(ocr.cut_features(v[w] if known else 0, 0, v.get(a, 0), v.get(b, 0), r.choice([0, 0, 1]), soft))
        y.append(1)
    for _ in range(2000):
        a, b = r.choice(words), r.choice(words)
        x.append(ocr.cut_features(0, int(10 ** r.uniform(0.3, 3.5)), v[a], v[b], r.choice([0, 0, 2]), False))
        y.append(2)
    for _ in range(2000):
        a, b = r.choice(words), r.choice(["und", "oder", "and", "et", "o", "e", "bzw", "ou", "y", "bis", "or"])
        x.append(ocr.cut_features(0, 0, r.choice([0, v[a]]), int(10 ** r.uniform(2, 5)), int(10 ** r.uniform(0.3, 3)), r.random() < 0.05))
        y.append(0)
    return np.array(x), np.array(y)


def _noisy(line: str, r: random.Random, rate: float) -> str:
    for _ in range(1 if r.random() < rate else 0):
        w = re.findall(r"\S+", line)
        if w:
            t = r.choice(w)
            m = misread(t, r)
            if m:
                line = line.replace(t, m if t.islower() else m.upper() if t.isupper() else m.capitalize(), 1)
    return line


def furniture_rows(r: random.Random):
    """Line pairs of made-up files: their running lines, and body lines that come first or last."""
    x, y = [], []
    bodies = [line for t in pii_table.LINES.values() for line in t.split("\n")]

    def body(width):
        s = " ".join(re.sub(r"\{\w+\}|<\w+>", "Lumdane 7", r.choice(bodies)).replace("¶", " ") for _ in range(3))
        i = r.randint(0, max(0, len(s) - width))
        s = s[i : i + width]
        return s[s.find(" ") + 1 : s.rfind(" ")] if r.random() < 0.8 else s[: r.randint(8, max(9, width // 2))]

    for _ in range(900):
        width = r.choice([50, 60, 72, 80])
        name = pii_table._word(r, pii_table._BRAND_HEADS, pii_table._BRAND_MIDS, pii_table._BRAND_TAILS)
        titles = [r.choice(["Annual Notes on {}", "Handbook of {} Storage", "{} Field Report", "The {} Reading Guide", "Jahresnotizen zu {}", "Rapport de terrain {}", "Manual de almacenaje {}", "Relazione sul campo {}", "Notas anuais sobre {}", "Der Leitfaden {}"]).format(name)]
        if r.random() < 0.3:
            titles.append(r.choice(["Chapter Two: Keeping Records", "Règles pour la nuit", "Kapitel Zwei: Akten führen", "Parte III Observaciones", "Regole per la notte"]))
        if r.random() < 0.4:
            titles = [t.upper() for t in titles]
        pages, place = r.randint(2, 8), r.choice([0, 0, 0, 1])
        number = r.choice([None, None, "{} | {}", "{}   {}"])
        start = r.randint(1, 60)
        lines = []
        for p in range(pages):
            if r.random() < 0.05:
                lines.append((None, None))
                continue
            t = titles[p % len(titles)]
            if number:
                t = number.format(t, start + p) if p % 2 else number.format(start + p, t).replace("|", " ")
            lines.append((_noisy(t, r, 0.2), r.random() < 0.6))
        at = lambda text, apart=False: ocr.Line(0, text, apart, width)
        for p, (line, apart) in enumerate(lines):
            around = [(at(lines[q][0] or body(width)), place, abs(q - p)) for q in range(max(0, p - 2), min(pages, p + 3)) if q != p]
            around += [(at(body(width)), k, a) for _, _, a in around for k in (0, 1, 2) if k != place]
            if line:
                x.append(ocr.line_features(at(line, apart), place, around))
                y.append(1)
            for k in (0, 1, 2):
                x.append(ocr.line_features(at(body(width), r.random() < 0.2), k, around))
                y.append(0)
    return np.array(x), np.array(y)


def main() -> None:
    r = random.Random(5)
    x, y = rank_rows(r)
    trees, base = boost(x, y)
    rank = ocr.Boosted(trees, base)
    missed: list[tuple[str, str]] = []
    hx, hy = rank_rows(random.Random(77), missed)
    s = rank.score(hx) >= 0
    print(f"rank: {len(y)} pairs, held-out precision {hy[s].mean():.4f}, recall {(s & (hy == 1)).sum() / (hy.sum() + len(missed)):.4f}, {len(missed)} missed by the lookup")
    cx, cy = cut_rows(r)
    cut = softmax_fit(cx, cy, 3)
    hx, hy = cut_rows(random.Random(78))
    print(f"cut: held-out accuracy {((hx @ cut.T).argmax(1) == hy).mean():.4f}")
    fx, fy = furniture_rows(r)
    two = softmax_fit(fx, fy, 2, steps=3000)
    w = two[1] - two[0]
    hx, hy = furniture_rows(random.Random(79))
    print(f"furniture: held-out accuracy {((hx @ w > 0) == hy).mean():.4f}, {Counter(zip((hx @ w > 0).tolist(), hy.tolist()))}")
    with open(ocr.MODEL, "w") as f:
        json.dump({"rank": {"trees": [{"feature": t["feature"], "at": [round(a, 5) for a in t["at"]], "leaf": [round(v, 5) for v in t["leaf"]]} for t in trees], "base": base, "at": 0.0}, "cut": cut.round(5).tolist(), "furniture": w.round(5).tolist()}, f)


if __name__ == "__main__":
    main()
