import pytest

from tessera.functions import config


def test_merge_and_override():
    a = {"x": {"y": 1, "z": 2}, "k": [1]}
    assert config.merged(a, {"x": {"y": 3}, "n": 1}) == {"x": {"y": 3, "z": 2}, "k": [1], "n": 1}
    assert config.merged(a, {"x": {"y": 3}}, "ignore") == a
    with pytest.raises(KeyError):
        config.merged(a, {"k": 2}, "raise")
    assert config.with_override(a, "x.y=0.5")["x"]["y"] == 0.5 and config.with_override(a, "x.q=true")["x"]["q"] is True
    with pytest.raises(ValueError):
        config.with_override(a, "x.y")


def test_tasks_and_arguments():
    c = {"data": {"tasks": {"a": 1, "b": 2}}, "heads": {"a": 3, "c": 4}}
    assert config.only_tasks(c, ["a"], ["data.tasks", "heads"]) == {"data": {"tasks": {"a": 1}}, "heads": {"a": 3}}
    assert config.as_list(None) == [] and config.as_list(3) == [3] and config.as_list(("1", "2"), int, cast=True) == [1, 2]
    with pytest.raises(TypeError):
        config.as_list(["a"], int)
    assert config.checked_columns(["a", "b"], "a") == ["a"]
    with pytest.raises(ValueError):
        config.checked_columns(["a"], ["z"])


def test_safe(capsys):
    with config.safe("step", raise_error=False):
        raise ValueError("no")
    assert "step failed" in capsys.readouterr().out
    with pytest.raises(ValueError), config.safe("step"):
        raise ValueError("no")
