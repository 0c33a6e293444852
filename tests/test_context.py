import numpy as np
import pandas as pd
import pytest

from tabloom.operators import context


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    f = pd.DataFrame(rng.normal(size=(200, 4)) * [1, 5, 2, 0.1], columns=list("abcd"))
    f["b"] += f.a * 9
    f["y"] = f.a * 2 - f.c + 3
    f["kind"] = np.where(f.a > 0.5, "high", np.where(f.a > -0.5, "mid", None))
    f.loc[::7, "c"] = np.nan
    f["few"] = np.arange(200) % 4
    return f


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if v is None or v != v else (int(v) if c == "few" else v if isinstance(v, str) else float(v)) for c, v in zip(frame.columns, r, strict=True)) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, kind string, few int").repartition(3)


def entries(out, kind):
    return [(r["name"], r["other"], r["value"]) for r in sorted(out.where(f"kind = '{kind}'").collect(), key=lambda r: r["rank"] or 0)]


def test_target_stats_decide_between_shares_and_moments(df, frame):
    assert {n: v for n, _, v in entries(context.target_stats(df, "few"), "share")} == {str(i): 0.25 for i in range(4)}
    assert [v for _, _, v in entries(context.target_stats(df, "y"), "moment")] == pytest.approx([frame.y.mean(), frame.y.std(), frame.y.min(), frame.y.max()])
    assert {n: v for n, _, v in entries(context.target_stats(df, "kind"), "share")} == pytest.approx(frame.kind.value_counts(normalize=True).to_dict())


def test_profile(df, frame):
    out = context.dataset_profile(df, "kind", "classification", ["f1", "f2"], top=2)
    assert {n: v for n, _, v in entries(out, "count")} == {"rows": 200, "columns": 7, "numeric": 6, "categorical": 1, "features": 2}
    assert [n for n, _, _ in entries(out, "missing")] == ["kind", "c"]
    var = frame[list("abcdy") + ["few"]].var().sort_values(ascending=False)
    assert [n for n, _, _ in entries(out, "variance")] == list(var.index[:2]) and entries(out, "variance")[0][2] == pytest.approx(var.iloc[0])
    assert sorted(n for n, _, _ in entries(out, "class")) == ["high", "mid"]


def test_context_for_new_features(df, frame):
    out = context.derived_context(df, "y", {"a": 0.2, "b": 0.7}, top=3)
    x = frame[list("abcd") + ["few"]]
    var = x.var().sort_values(ascending=False)
    assert [n for n, _, _ in entries(out, "variance")] == list(var.index[:4])
    assert entries(out, "pair")[0][:2] == (var.index[0], var.index[1]) and len(entries(out, "pair")) == 3
    corr = x.corr().abs()
    want = sorted(((corr.iloc[i, j], corr.index[i], corr.index[j]) for i in range(5) for j in range(i + 1, 5)), reverse=True)[:3]
    assert [(a, b) for a, b, _ in entries(out, "correlation")] == [(a, b) for _, a, b in want] and entries(out, "correlation")[0][2] == pytest.approx(want[0][0])
    assert [n for n, _, _ in entries(out, "target_correlation")] == list(x.corrwith(frame.y).abs().sort_values(ascending=False).index[:3])
    assert [n for n, _, _ in entries(out, "importance")] == ["b", "a"] and [n for n, _, _ in entries(out, "unused")] == ["c", "d", "few"]
    groups = entries(context.derived_context(df, "kind", top=2), "group_mean")
    assert len(groups) == 6 and {o for _, o, _ in groups} == {"high", "mid", "null"}


def test_empty_tables(df):
    none = df.limit(0)
    assert entries(context.dataset_profile(none), "missing") == [] and context.derived_context(none.select("kind"), "kind").count() == 0
    assert context.target_stats(none, "kind").count() == 0
