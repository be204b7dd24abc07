"""Session helpers: the checkpoint folder comes from the session when it is set."""

from __future__ import annotations

from campaign_analytics.session import BASE_CONF, default_parallelism, ensure_checkpoint_dir


def test_checkpoint_dir_is_taken_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    got = ensure_checkpoint_dir(spark)
    assert configured and configured.rstrip("/").split("/")[-1] in got


def test_session_settings(spark):
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.session.timeZone"):
        assert spark.conf.get(key) == BASE_CONF[key]
    assert spark.conf.get("spark.ui.enabled") == "false"
    assert default_parallelism(spark) == 8
