"""The shared folder, where the session names one and where it doesn't."""

import os

from tallysheaf.llm import shared


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default):
        return self.values.get(key, default)


class Session:
    def __init__(self, values, master, app):
        self.conf = Conf(values)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": app})()


def test_a_named_folder_is_used():
    assert shared.shared_folder(Session({"spark.checkpoint.dir": "/shared/here"}, "spark://x:1", "a")) == "/shared/here"


def test_without_one_a_local_session_gets_one_folder_for_all_calls():
    one = shared.shared_folder(Session({}, "local[2]", "test-1"))
    assert os.path.isdir(one) and shared.shared_folder(Session({}, "local", "test-1")) == one
    assert shared.shared_folder(Session({}, "local[2]", "test-2")) != one


def test_without_one_a_cluster_is_refused():
    try:
        shared.shared_folder(Session({}, "spark://x:1", "test-3"))
    except ValueError as refused:
        assert "spark.checkpoint.dir" in str(refused)
    else:
        raise AssertionError("not refused")


def test_stored_without_a_checkpoint_folder(spark):
    assert shared.stored(spark.range(3), "three").count() == 3
