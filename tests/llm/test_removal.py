"""Nothing outside this subpackage imports it."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_only_the_entry_and_the_pipeline_import_it():
    for path in [*ROOT.glob("*.py"), *ROOT.glob("netloom/**/*.py"), *ROOT.glob("tests/*.py")]:
        inside = "llm" in path.relative_to(ROOT).parts
        if not inside and path.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert not re.search(r"^\s*(from|import)\s.*llm", path.read_text(), re.M), path


def test_every_contract_has_one_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
