import pytest

from ledgerlens import session as S


def test_bounded_rows_raise_and_never_cut(spark):
    d = spark.range(5)
    assert len(S.bounded_rows(d, 5, "x")) == 5
    with pytest.raises(ValueError):
        S.bounded_rows(d, 4, "x")


def test_spread_leaves_large_inputs(spark, monkeypatch):
    d = spark.range(10).coalesce(1)
    assert S.spread(d).rdd.getNumPartitions() >= 4
    monkeypatch.setattr(S, "_bytes", lambda df: 1 << 50)
    assert S.spread(d).rdd.getNumPartitions() == 1
    assert [S._bytes_of(x) for x in ("134217728b", "16m", "1g", "512")] == [134217728, 16 << 20, 1 << 30, 512]


def test_broadcast_only_if_small(spark):
    d = spark.range(5)
    plan = lambda x: x._jdf.queryExecution().logical().toString()
    assert "Hint" in plan(S.broadcast_if_small(d, 5)) and "Hint" not in plan(S.broadcast_if_small(d, 4))


def test_checkpoint_goes_to_the_named_folder(spark):
    S.shared_checkpoint(spark.range(3)).count()
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_models_are_kept_by_token():
    made = []
    build = lambda: made.append(1) or [len(made)]
    a = S.kept("a", build)
    assert S.kept("a", build) is a and S.kept("b", build) != a
    S.kept("c", build)
    assert S.kept("c", build) == [3] and len(made) == 3 and S.kept("a", build) == [4]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    import pytest

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError):
        S.shared_checkpoint(Frame())
