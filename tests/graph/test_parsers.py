import pytest
from exact_programs import EXACT
from sources_by_language import SOURCES

from loomgraph.sources import walk
from loomgraph.sources.parsers import docs, languages


@pytest.mark.parametrize("language", list(SOURCES))
def test_facts(language):
    source, kinds, imports, calls, types = SOURCES[language]
    facts = languages.parse(source, language)
    found = {}
    for d in facts["definitions"]:
        found.setdefault(d["name"], set()).add(d["kind"])
    assert {k: found.get(k) for k in kinds} == kinds
    assert {i["module_path"] for i in facts["imports"]} == imports
    assert calls <= {(c["caller"], c["callee"], c["call_kind"]) for c in facts["calls"]}
    assert not {c["callee"] for c in facts["calls"]} & {"call", "fake", "no_call", "Item::fake"}
    assert types <= {(t["source"], t["type_name"], t["ref_kind"]) for t in facts["type_refs"]}


@pytest.mark.parametrize("language", list(EXACT))
def test_exactly_these_facts(language):
    source, definitions, calls = EXACT[language]
    facts = languages.parse(source, language)
    assert {(d["name"], d["kind"]) for d in facts["definitions"]} == definitions
    assert {(c["caller"], c["callee"], c["call_kind"]) for c in facts["calls"]} == calls


@pytest.mark.parametrize(("language", "name", "doc"), [("rust", "Store", "Holds things."), ("python", "Child", "Says things."), ("go", "Server", "Server serves."), ("javascript", "add", "Adds."), ("java", "Service", "A service."), ("ruby", "Sorter", "Sorts things."), ("lua", "M.add", "Adds."), ("swift", "Circle", "A circle."), ("haskell", "Tree", "A tree."), ("scala", "Item", "Runs.")])
def test_documentation(language, name, doc):
    found = [d["doc"] for d in languages.parse(SOURCES[language][0], language)["definitions"] if d["name"] == name]
    assert doc in found


def test_locations_and_metadata():
    facts = languages.parse(SOURCES["rust"][0], "rust")
    impl = next(d for d in facts["definitions"] if d["kind"] == "impl_trait")
    assert (impl["start_line"], impl["end_line"], impl["metadata"]) == (11, 19, {"trait": '"Run"'})
    circle = next(d for d in languages.parse(SOURCES["cpp"][0], "cpp")["definitions"] if d["name"] == "Circle")
    assert circle["metadata"] == {"bases": '["Shape", "Round"]'}
    child = next(d for d in languages.parse(SOURCES["python"][0], "python")["definitions"] if d["name"] == "Child")
    assert child["metadata"] == {"bases": '["Base"]'}
    glob = [i["is_glob"] for i in facts["imports"]]
    assert glob == [False, False, True]


def test_every_language_takes_any_text():
    for language in [*SOURCES, "unknown"]:
        for text in ("", "\n", "((((", "}}}}", '"', "'", "/*", "fn", "def f(", "é中", "class\n" * 50):
            try:
                facts = languages.parse(text, language)
            except SyntaxError:
                assert language == "python"
            else:
                assert set(facts) == {"imports", "definitions", "calls", "type_refs"}


def test_ignore_rules():
    rules = walk.parse_rules("# comment\n*.log\n!keep.log\nbuild/\n/top.txt\na/**/z\n", "") + walk.parse_rules("local.*\n", "sub")
    out = {p for p in ("x.log", "d/x.log", "keep.log", "build/a.rs", "d/build/a.rs", "build", "top.txt", "d/top.txt", "a/z", "a/b/c/z", "sub/local.rs", "local.rs") if walk.ignored(p, rules)}
    assert out == {"x.log", "d/x.log", "build/a.rs", "d/build/a.rs", "top.txt", "a/z", "a/b/c/z", "sub/local.rs"}


def test_block_cleanup():
    assert docs.clean("/**\n * One.\n *\n * @param x y\n * Two.\n */") == "One.\nTwo."
