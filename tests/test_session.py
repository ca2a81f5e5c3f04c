"""Session settings and the shared scratch folder."""

import pytest

from shredkit.session import build_session, scratch_root, table_catalog_conf


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Remote:
    """A session on a cluster whose checkpoint folder is not set."""

    conf = _Conf({"spark.master": "spark://host:7077"})

    @property
    def sparkContext(self):
        raise RuntimeError("no context")


def test_a_cluster_without_a_shared_folder_raises():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(_Remote())


def test_session_settings(spark):
    s = build_session()
    assert s.conf.get("spark.sql.session.timeZone") == "UTC"
    assert s.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert s.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert scratch_root(s) == s.conf.get("spark.checkpoint.dir").rstrip("/")


def test_catalog_settings():
    c = table_catalog_conf("lake", "hadoop", "/w")
    assert c["spark.sql.catalog.lake.type"] == "hadoop" and "spark.sql.catalog.lake.catalog-impl" not in c
    g = table_catalog_conf("lake", "glue", "/w")
    assert "spark.sql.catalog.lake.type" not in g and g["spark.sql.catalog.lake.catalog-impl"].endswith("GlueCatalog")
