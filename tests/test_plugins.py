"""Registry and configuration: look-up, reload, updates."""

from tallyspark.plugins import Parser, Registry, built_in
from tallyspark.sources.accounts import Config

MODULE = """
from tallyspark.plugins import Parser
PARSERS = [Parser({name!r}, None, (".csv",), {priority})]
"""


def test_look_up_by_ending():
    registry = built_in(2024)
    registry.register(Parser("mine", None, (".CSV", ".tsv"), 3))
    assert [p.name for p in registry.for_ending("csv")] == ["mine", "csv"] and [p.name for p in registry.for_ending(".TSV")] == ["mine"] and registry.for_ending("doc") == []


def test_reload(tmp_path):
    registry = Registry()
    registry.register(Parser("base", None, (".csv",)))
    (tmp_path / "a.py").write_text(MODULE.format(name="one", priority=1))
    (tmp_path / "b.py").write_text(MODULE.format(name="two", priority=2))
    assert registry.discover(str(tmp_path)) == 2 and registry.choose("x.csv").name == "two"
    (tmp_path / "b.py").unlink()
    (tmp_path / "a.py").write_text(MODULE.format(name="three", priority=5))
    assert registry.reload(str(tmp_path)) == 1 and sorted(registry.parsers) == ["base", "three"] and registry.choose("x.csv").name == "three"


def test_configuration_updates():
    config = Config(institutions={"Chase": {"parser_type": "csv"}})
    new, wrong = config.updated(raw_directory="in", skip_processed=False, nothing=1)
    assert (new.raw_directory, new.skip_processed, config.raw_directory) == ("in", False, "raw") and wrong == ["unknown setting nothing"]
    same, wrong = config.updated(skip_processed="yes", raw_directory="in")
    assert same == config and len(wrong) == 1
    assert config.of_institution("CHASE") == {"parser_type": "csv"} and config.of_institution("x") is None
