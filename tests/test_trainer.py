"""Training in epochs (T5, T7, W-1, T2) against plain computations."""

import hashlib
import json
import math
import re
import shutil

import numpy as np
import pyarrow as pa
import pytest

from labelscope.operators import history as hist
from labelscope.operators import trainer as T

LABELS = [3, 5, 9]


@pytest.mark.parametrize("loss", T.LOSSES)
def test_slopes_equal_finite_differences(loss):
    rng = np.random.default_rng(1)
    z, y, alpha = rng.normal(size=(40, 4)) * 3, rng.integers(0, 4, 40), rng.uniform(0.2, 4, 4)
    _, slope = T.loss_and_slope(z, y, loss, alpha, 2.0)
    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-6
        up, down = (T.loss_and_slope(z + s * step, y, loss, alpha, 2.0)[0] for s in (1, -1))
        assert np.allclose((up - down) / 2e-6, slope[:, k], atol=1e-6, rtol=1e-5)


def test_losses_by_hand():
    z, y, alpha = np.array([[1.0, 0.0], [0.0, 50.0], [0.0, 900.0]]), np.array([0, 1, 0]), np.array([2.0, 0.5])
    p = 1 / (1 + math.exp(-1))
    assert np.allclose(T.loss_and_slope(z, y, "ce", alpha, 2.0)[0], [-math.log(p), 0, 900])
    assert np.allclose(T.loss_and_slope(z, y, "weighted", alpha, 2.0)[0], [-2 * math.log(p), 0, 1800])
    ce = -2 * math.log(p)
    each, slope = T.loss_and_slope(z, y, "focal", alpha, 3.0)
    assert np.allclose(each, [(1 - math.exp(-ce)) ** 3 * ce, 0, 1800]) and np.isfinite(slope).all()


def plain_row(text, dims):
    out = {}
    for w in re.split("[ \t\r\n]+", text or ""):
        if w:
            f = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims
            out[f] = out.get(f, 0) + 1
    norm = math.sqrt(sum(n * n for n in out.values()))
    return {f: n / norm for f, n in out.items()}


def test_features_equal_a_plain_count():
    texts = ["a b  a\tc\nä", "", None, "  ", "one", "x " * 500]
    row, feature, value = T.text_features(pa.array(texts), 7)
    for i, t in enumerate(texts):
        got = dict(zip(feature[row == i].tolist(), value[row == i].tolist()))
        assert got.keys() == plain_row(t, 7).keys() and all(abs(got[f] - v) < 1e-12 for f, v in plain_row(t, 7).items())


def corpus(n=240):
    rng = np.random.default_rng(2)
    words = [["for", "while", "int"], ["def", "self", "int"], ["fn", "let", "mut"]]
    rows = []
    for i in range(n):
        c = int(rng.choice(3, p=[0.7, 0.2, 0.1]))
        text = " ".join(rng.choice(words[c] + ["x", "y", "z", "="], 12)) if i % 50 else (None if i % 100 else "")
        rows.append((i, text, LABELS[c]))
    return rows


def frames(spark, rows):
    df = spark.createDataFrame(rows, "id long, code string, label int")
    return df.where("id % 5 > 0"), df.where("id % 5 = 0")


def plain_train(rows, epochs, steps, dims, loss, gamma, rate, warm_up, seed=42):
    def dense(part):
        x = np.zeros((len(part), dims + 1))
        for n, (_, t, _) in enumerate(part):
            for f, v in plain_row(t, dims).items():
                x[n, f] = v
            x[n, -1] = 1
        return x, np.array([LABELS.index(r[2]) for r in part])

    train, held = [r for r in rows if r[0] % 5], [r for r in rows if r[0] % 5 == 0]
    batches = [dense([r for r in train if int(hashlib.md5(f"{seed}:step:{r[0]}".encode()).hexdigest()[:12], 16) % steps == s]) for s in range(steps)]
    vx, vy = dense(held)
    n = np.bincount([LABELS.index(r[2]) for r in train], minlength=3)
    alpha = np.array([n.sum() / ((n > 0).sum() * c) if c else 0 for c in n])
    w, m, v, t, out = np.zeros((3, dims + 1)), 0, 0, 0, []
    total = epochs * steps
    for e in range(epochs):
        losses, seen = [], []
        for x, y in batches:
            z = x @ w.T
            each, slope = T.loss_and_slope(z, y, loss, alpha, gamma)
            losses.append(each.mean())
            seen += list(zip(y, z.argmax(axis=1)))
            g = slope.T @ x / len(y)
            g = g * min(1, 1 / (np.linalg.norm(g) + 1e-6))
            warm = int(warm_up * total)
            r = rate * (t / max(1, warm) if t < warm else 0.5 * (1 + math.cos(math.pi * (t - warm) / (total - warm))))
            t += 1
            w = w * (1 - r * 0.01)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - r * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        out.append((e + 1, float(np.mean(losses)), f1(seen), f1(list(zip(vy, (vx @ w.T).argmax(axis=1))))))
    return out, w


def f1(pairs):
    each = []
    for k in {a for p in pairs for a in p}:
        tp = sum(a == b == k for a, b in pairs)
        each.append(2 * tp / (sum(a == k for a, _ in pairs) + sum(b == k for _, b in pairs)))
    return sum(each) / len(each)


@pytest.mark.parametrize("loss", T.LOSSES)
def test_training_equals_a_plain_loop(spark, tmp_path, loss):
    rows = corpus()
    train, held = frames(spark, rows)
    history, best = T.train_epochs(spark, train.repartition(3), held, "id", labels=LABELS, state_dir=str(tmp_path / "run"), epochs=3, steps=4,
                                   dims=64, loss=loss, rate=0.2, warm_up=0.2)
    expect, w = plain_train(rows, 3, 4, 64, loss, 2.0, 0.2, 0.2)
    got = [tuple(r) for r in history.orderBy("epoch").collect()]
    assert [g[0] for g in got] == [1, 2, 3] and np.allclose(got, expect, atol=1e-9)
    assert np.allclose(T.State.load(spark, str(tmp_path / "run" / "epoch-3"))[0].w, w, atol=1e-9)
    top = hist.best_epoch(history).first()
    assert best.endswith(f"epoch-{top['epoch']}") and top["val_f1"] > f1([(r[2], LABELS[0]) for r in rows if r[0] % 5 == 0])
    events = [r["epoch"] for r in hist.checkpoint_events(history).orderBy("epoch").collect()]
    assert events[-1] == top["epoch"] and events[0] == 1


def test_an_interrupted_run_goes_on(spark, tmp_path):
    train, held = frames(spark, corpus())
    kw = dict(labels=LABELS, epochs=3, steps=2, dims=32, loss="focal")
    whole, best = T.train_epochs(spark, train, held, "id", state_dir=str(tmp_path / "a"), **kw)
    shutil.copytree(tmp_path / "a", tmp_path / "b", ignore=shutil.ignore_patterns("epoch-2", "epoch-3"))
    again, best2 = T.train_epochs(spark, train, held, "id", state_dir=str(tmp_path / "b"), **kw)
    assert sorted(whole.collect()) == sorted(again.collect()) and best[-7:] == best2[-7:]
    third, _ = T.train_epochs(spark, train, held, "id", state_dir=str(tmp_path / "a"), **kw)  # nothing left to do
    assert sorted(whole.collect()) == sorted(third.collect())
    with pytest.raises(ValueError, match="other parameters"):
        T.train_epochs(spark, train, held, "id", state_dir=str(tmp_path / "a"), **(kw | {"rate": 0.5}))


def test_scores_of_a_saved_model(spark, tmp_path):
    rows = corpus()
    train, held = frames(spark, rows)
    _, best = T.train_epochs(spark, train, held, "id", labels=LABELS, state_dir=str(tmp_path / "run"), epochs=2, steps=3, dims=64)
    w = T.State.load(spark, best)[0].w
    got = {r["id"]: r for r in T.score_texts(spark, best, held.repartition(3), "id", keep=["label"], batch_size=7).collect()}
    assert len(got) == held.count()
    for i, t, label in rows:
        if i % 5 == 0:
            x = np.zeros(65)
            for f, v in plain_row(t, 64).items():
                x[f] = v
            x[-1] = 1
            assert np.allclose(got[i]["logits"], w @ x) and got[i]["y_pred"] == LABELS[int(np.argmax(w @ x))] and got[i]["label"] == label
    assert T.score_texts(spark, best, held.limit(0), "id").collect() == []


def test_language_prefix_is_part_of_the_model(spark, tmp_path):
    df = spark.createDataFrame([(i, "same words", "C" if i % 2 else "Go", i % 2) for i in range(40)], "id long, code string, language string, label int")
    _, best = T.train_epochs(spark, df, df, "id", labels=[0, 1], state_dir=str(tmp_path / "run"), epochs=1, steps=5, dims=64, language_col="language")
    assert all(r["label"] == r["y_pred"] for r in T.score_texts(spark, best, df, "id", keep=["label"]).collect())
    assert json.loads(next(r["json"] for r in spark.read.parquet(best).collect() if r["json"]))["language_col"] == "language"


def test_wrong_labels_and_losses_raise(spark, tmp_path):
    bad = spark.createDataFrame([(1, "a", 4)], "id long, code string, label int")
    with pytest.raises(Exception, match="label not in the list"):
        T.train_epochs(spark, bad, bad, "id", labels=LABELS, state_dir=str(tmp_path / "x"), epochs=1, steps=1, dims=8)
    with pytest.raises(ValueError):
        T.train_epochs(spark, bad, bad, "id", labels=LABELS, state_dir=str(tmp_path / "y"), loss="hinge")


def test_balanced_weights_skip_absent_classes():
    assert T.balanced_weights(np.array([6, 0, 2])).tolist() == [8 / 12, 0, 2.0]
