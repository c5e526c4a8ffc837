"""learned_scores: texts are split once, not in every fit and threshold."""

from quern.operators import evaluate
from quern.plans import evaluation


def test_folds_are_cut_from_written_rows(spark, monkeypatch):
    seen = []
    whole = evaluate.leave_family_out
    monkeypatch.setattr(evaluation.evaluate, "leave_family_out", lambda df, *args, **more: seen.append(df.inputFiles()) or whole(df, *args, **more))
    evaluation.learned_scores(spark, "/root/testdata/sf0.001")
    assert seen and not any("documents" in f for files in seen for f in files)
