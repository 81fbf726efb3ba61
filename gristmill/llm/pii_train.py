"""Trains the tagger of personal information: python -m gristmill.llm.pii_train [lang_samples.parquet]"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

import numpy as np

from gristmill.llm import pii, pii_table


ROWS = 16_000


def encode(rows):
    """Tokens and labels of labelled texts."""
    out = []
    for text, spans in rows:
        tokens = [(m.start(), m.end()) for m in pii._TOKEN.finditer(text)]
        keys = pii.read(text)[1]
        y = np.zeros(len(tokens), np.int64)
        for a, b, kind in spans:
            k = 2 * pii.KINDS.index(kind) + 1
            first = True
            for i, (x, z) in enumerate(tokens):
                if a <= x < b or x <= a < z:
                    y[i] = k if first else k + 1
                    first = False
        out.append((keys, y))
    return out


def log_sum(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(rows, epochs=5, rate=0.15, l2=2e-6, seed=1, min_count=2, batch=48):
    data = encode(rows)
    counts: Counter = Counter()
    for tokens, _ in data:
        for t in set(tokens):
            counts.update(pii.features(pii._key(t)))
    names = sorted(f for f, n in counts.items() if n >= min_count)
    at = {f: i for i, f in enumerate(names)}
    n_labels, span = len(pii.LABELS), 2 * pii.REACH + 1
    feats: dict[str, np.ndarray] = {}

    def of(token):
        if token not in feats:
            feats[token] = np.array([at[f] for f in pii.features(pii._key(token)) if f in at], np.int64)
        return feats[token]

    w = np.zeros((len(names) + 1, span, n_labels))
    gw = np.full_like(w, 1e-6)
    moves, gm = np.zeros((n_labels, n_labels)), np.full((n_labels, n_labels), 1e-6)
    wall = np.where(pii._ALLOWED, 0.0, -1e4)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        loss = 0.0
        for s in range(0, len(order), batch):
            group = [data[i] for i in order[s : s + batch] if len(data[i][0])]
            length = np.array([len(t) for t, _ in group])
            width, n = int(length.max()), len(group)
            uniq: dict[str, int] = {"": 0}
            ids = np.zeros((n, width + 2 * pii.REACH), np.int64)
            y = np.zeros((n, width), np.int64)
            for r, (tokens, labels) in enumerate(group):
                ids[r, pii.REACH : pii.REACH + len(tokens)] = [uniq.setdefault(t, len(uniq)) for t in tokens]
                y[r, : len(tokens)] = labels
            lists = [of(t) for t in uniq]
            rows_ = np.stack([w[f].sum(0) for f in lists])
            e = np.zeros((n, width, n_labels))
            for k in range(span):
                e += rows_[ids[:, k : k + width], k]
            m = moves + wall
            live = np.arange(width)[None] < length[:, None]
            alpha = np.zeros((width, n, n_labels))
            alpha[0] = e[:, 0] + m[0]
            for t in range(1, width):
                a = log_sum(alpha[t - 1][:, :, None] + m[None], 1) + e[:, t]
                alpha[t] = np.where(live[:, t, None], a, alpha[t - 1])
            z = log_sum(alpha[width - 1], 1)
            beta = np.zeros((width, n, n_labels))
            gmoves = np.zeros_like(moves)
            for t in range(width - 2, -1, -1):
                nxt = (e[:, t + 1] + beta[t + 1])[:, None, :] + m[None]
                beta[t] = np.where(live[:, t + 1, None], log_sum(nxt, 2), 0.0)
                pair = np.exp(np.minimum(0, alpha[t][:, :, None] + nxt - z[:, None, None])) * live[:, t + 1, None, None]
                gmoves += pair.sum(0)
                ok = live[:, t + 1]
                np.add.at(gmoves, (y[ok, t], y[ok, t + 1]), -1.0)
            p = np.exp(np.minimum(0, alpha + beta - z[None, :, None])).transpose(1, 0, 2) * live[:, :, None]
            gold = np.take_along_axis(e, y[:, :, None], 2).squeeze(2)
            path = (gold * live).sum(1) + m[0, y[:, 0]] + ((m[y[:, :-1], y[:, 1:]]) * live[:, 1:]).sum(1)
            loss += float((z - path).sum())
            ge = p.copy()
            np.put_along_axis(ge, y[:, :, None], np.take_along_axis(ge, y[:, :, None], 2) - live[:, :, None], 2)
            gtok = np.zeros((len(uniq), span, n_labels))
            for k in range(span):
                np.add.at(gtok[:, k], ids[:, k : k + width], ge)
            touched = defaultdict(list)
            for u, f in enumerate(lists):
                for x in f:
                    touched[x].append(u)
            fs = np.fromiter(touched, np.int64)
            g = np.stack([gtok[us].sum(0) for us in touched.values()]) / n + l2 * w[fs]
            gw[fs] += g * g
            w[fs] -= rate * g / np.sqrt(gw[fs])
            gmoves /= n
            gm += gmoves * gmoves
            moves -= rate * gmoves / np.sqrt(gm)
        print(f"epoch {epoch}: loss {loss / len(order):.3f}", flush=True)
    w = w[:-1]
    keep = np.abs(w).max((1, 2)) > 0.08
    return [f for f, k in zip(names, keep) if k], w[keep], moves


def main(samples: str | None = None) -> None:
    plain: dict[str, list[str]] = defaultdict(list)
    if samples:
        import pyarrow.parquet as pq

        for r in pq.read_table(samples, columns=["lang", "text"]).to_pylist():
            plain[r["lang"]].append(r["text"])
    names, w, moves = train(pii_table.labelled(ROWS, 11, plain))
    np.savez_compressed(pii.WEIGHTS, names=np.array(names), weights=w.astype(np.float16), moves=moves.astype(np.float32))
    model = pii.Tagger(names, w, moves)
    held = pii_table.labelled(1500, 99, plain)
    hit = miss = extra = 0
    for (_, spans), found in zip(held, pii.find([t for t, _ in held], model)):
        want, got = {(k, a, b) for a, b, k in spans}, set(found)
        hit, miss, extra = hit + len(want & got), miss + len(want - got), extra + len(got - want)
    print(f"held-out: precision {hit / (hit + extra):.4f}, recall {hit / (hit + miss):.4f}, {len(names)} features")


if __name__ == "__main__":
    main(*sys.argv[1:])
