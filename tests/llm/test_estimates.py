"""Brute-force checks of what is estimated: the classifier's gradients and prior, expectation-maximisation and the span
classifier of personal data, propagated secrets."""

import math
import random

import numpy as np

from weekloom.llm import pii, quality_classifier, secrets


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (40, 5))
    m = quality_classifier.Model(x.mean(0), x.std(0) + 1e-3, np.random.default_rng(1))
    z, g = m.z(x), rng.normal(0, 1, 40)
    found = m.gradient(z, g)
    for k, p in enumerate(m.p):
        flat = np.asarray(p, float)
        for at in [tuple(rng.integers(0, n) for n in flat.shape) for _ in range(6)]:
            value = []
            for step in (1e-6, -1e-6):
                moved = [np.array(q, float) for q in m.p]
                moved[k][at] += step
                keep, m.p = m.p, moved
                value.append(float((g * m.logit(z)).sum()))
                m.p = keep
            assert abs((value[0] - value[1]) / 2e-6 - np.asarray(found[k])[at]) < 1e-4


def test_risk_goes_down_and_beats_naive_labels():
    """Positives and an unlabelled mix of known share: the non-negative risk with the true prior ranks and calibrates better
    than taking all unlabelled rows as negative."""
    rng = np.random.default_rng(5)
    yes, no = rng.normal(1.2, 1, (600, 4)), rng.normal(-1.2, 1, (400, 4))
    positive, unlabelled = yes[:200], np.vstack([yes[200:], no])
    truth = np.r_[np.ones(400), np.zeros(400)]
    model = quality_classifier.train(positive, unlabelled, 0.5)
    logit = model.logit(model.z(unlabelled))
    fp, fu = model.logit(model.z(positive)), logit
    loss = lambda f: np.logaddexp(0, -f).mean()
    risk = 0.5 * loss(fp) + max(0.0, np.logaddexp(0, fu).mean() - 0.5 * np.logaddexp(0, fp).mean())
    assert risk < 0.3 < math.log(2)  # of a model that knows nothing
    assert ((logit > 0) == truth).mean() > 0.95
    naive = np.r_[np.ones(200), np.zeros(800)]
    assert ((model.logit(model.z(np.vstack([positive, unlabelled]))) > 0) == naive).mean() < 0.7  # unlabelled positives stay positive


def test_full_passes_against_plain_steps(spark):
    """The refined model equals plain full-batch steps of the same risk, however the rows are dealt."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0.8, 1, (150, 3)), rng.normal(-0.8, 1, (150, 3))]).astype(np.float32).astype(float)
    liked = np.arange(300) < 60
    for prior in (0.5, 0.98):  # the second makes the negative part negative
        begun = quality_classifier.Model(x.mean(0), x.std(0), np.random.default_rng(2))
        rows = spark.createDataFrame([([float(v) for v in r], bool(y)) for r, y in zip(x, liked)], "x array<float>, liked boolean")
        got = [quality_classifier.refine(begun, rows.repartition(n), prior, 4) for n in (1, 7)]
        assert all((a == b).all() for a, b in zip(got[0].p, got[1].p))
        m = begun.copy([a.copy() for a in begun.p])
        first, second = [np.zeros_like(a) for a in m.p], [np.zeros_like(a) for a in m.p]
        for step in range(1, 5):
            zu, zp = m.z(x), m.z(x[liked])
            su, sp = (1 / (1 + np.exp(-m.logit(z))) for z in (zu, zp))
            gu, plus, minus = m.gradient(zu, su / 300), m.gradient(zp, prior * (sp - 1) / 60), m.gradient(zp, prior * sp / 60)
            negative = np.logaddexp(0, m.logit(zu)).mean() - prior * np.logaddexp(0, m.logit(zp)).mean()
            for i, p in enumerate(m.p):
                g = (plus[i] + gu[i] - minus[i] if negative >= 0 else minus[i] - gu[i]) + quality_classifier.DECAY * p
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                m.p[i] = p - quality_classifier.RATE * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        assert all(np.abs(a - b).max() < 5e-5 for a, b in zip(m.p, got[0].p))


def test_prior_against_sorted_scores():
    rng = np.random.default_rng(7)
    for share in (0.2, 0.5, 0.8):
        p = np.clip(rng.normal(0.75, 0.1, 4000), 0, 0.9999)
        u = np.r_[np.clip(rng.normal(0.75, 0.1, int(6000 * share)), 0, 0.9999), np.clip(rng.normal(0.3, 0.1, 6000 - int(6000 * share)), 0, 0.9999)]
        bins = lambda s: np.bincount((s * quality_classifier.BINS).astype(int), minlength=quality_classifier.BINS)
        got = quality_classifier.class_prior(bins(p), bins(u))
        margin, best = math.sqrt(math.log(40) / 2 / len(p)) + math.sqrt(math.log(40) / 2 / len(u)), None
        for b in range(quality_classifier.BINS):  # every cut of the tail
            qp, qu = (p >= b / quality_classifier.BINS).mean(), (u >= b / quality_classifier.BINS).mean()
            if qp >= 0.02 and (best is None or (qu + margin) / qp < best[0] - 1e-12):
                best = (qu + margin) / qp, qu / qp
        assert abs(got - best[1]) < 0.01 and abs(got - share) < 0.06


def slow_em(rows, rounds):
    """Posteriors case by case: every row as often as it occurs."""
    cases = [(k, v) for k, _, v, n in rows for _ in range(n)]
    q = [1 / (1 + math.exp(-sum(v))) for _, v in cases]
    for _ in range(rounds):
        like = []
        for c in (0, 1):
            w = [x if c else 1 - x for x in q]
            kinds = {k: 1 + sum(a for a, (kk, _) in zip(w, cases) if kk == k) for k in range(len(pii.KINDS))}
            each = [{s: 1 + sum(a for a, (_, v) in zip(w, cases) if v[i] == s) for s in (-1, 0, 1)} for i in range(len(pii.LABELERS))]
            like.append([kinds[k] * math.prod(each[i][x] / sum(each[i].values()) for i, x in enumerate(v)) for k, v in cases])
        q = [b / (a + b) for a, b in zip(*like)]
    return {(k, v): x for (k, v), x in zip(cases, q)}


def test_expectation_maximisation_case_by_case():
    rng = random.Random(2)
    seen: dict = {}
    for _ in range(500):
        real = rng.random() < 0.4
        v = tuple(rng.choices((-1, 0, 1), (1, 3, 8 - i) if real else (6 - i, 3, 1))[0] for i in range(len(pii.LABELERS)))
        key = (rng.randrange(len(pii.KINDS)), rng.randrange(4), v)
        seen[key] = seen.get(key, 0) + 1
    rows = sorted((k, f, v, n) for (k, f, v), n in seen.items())
    got = pii.reliabilities(rows)
    want = slow_em(rows, pii.ROUNDS)
    assert all(abs(p - want[k, v]) < 1e-9 for (k, _, v, _), p in zip(rows, got))
    # the span classifier comes close to the posteriors it is fitted to
    w = pii.span_classifier(rows, got)
    fitted = [1 / (1 + math.exp(-sum(w[i] for i in pii._inputs(k, f, v)))) for k, f, v, _ in rows]
    total = sum(n for *_, n in rows)
    cross = -sum(n * (p * math.log(max(x, 1e-9)) + (1 - p) * math.log(max(1 - x, 1e-9))) for (*_, n), p, x in zip(rows, got, fitted)) / total
    entropy = -sum(n * sum(y * math.log(y) for y in (p, 1 - p) if y > 0) for (*_, n), p in zip(rows, got)) / total
    assert cross < entropy + 0.1


def test_added_secrets_against_a_plain_reading():
    """Lines of name = "value" or name = other name: what reaches a sensitive name and looks like a key is added, once."""
    rng = random.Random(6)
    letters = "ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"
    for _ in range(150):
        names = [rng.choice(["auth_key", "clientSecret", "color", "width", "pwd_salt", "title", "a", "b"]) + str(rng.randrange(3)) for _ in range(8)]
        text, values, want = "", {}, set()
        for name in names:
            if values and rng.random() < 0.4:
                other = rng.choice(sorted(values))
                text += f"{name} = {other}\n"
                values[name] = values[other]
            else:
                value = "".join(rng.choice(letters) for _ in range(rng.choice([6, 20, 24]))) if rng.random() < 0.7 else rng.choice(["plain", "changeme", "12345678"])
                at = len(text) + len(name) + 4
                text += f'{name} = "{value}"\n'
                values[name] = (at, at + len(value))
            s, e = values[name]
            score = secrets.literal_score(text[s:e])
            if secrets.name_score(name) >= 0.5 and secrets.name_score(name) + score >= secrets.LEAST_SCORE + 0.5 and score >= 0.5:
                want.add((s, e))
        base = {(s, e) for k, s, e in secrets.scan(text) if k != "literal"}
        assert {(s, e) for k, s, e in secrets.scan(text) if k == "literal"} == want - base, text
