"""The driver's entry with the optional part, without it, and without a package that only it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from factsieve import registry
assert set(registry.queries()) == set(entry.queries()) and set(registry.queries()) <= set(entry.oracle_sql())
"""


def imported_without(name):
    code = CODE.format(name=name, root=str(ROOT))
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("name", ["factsieve.llm", "corpus_pipeline", "zstandard", "tiktoken", "tokenizers", "xxhash"])
def test_other_queries_stay_without_the_optional_part(name):
    if not (ROOT / "factsieve" / "llm").is_dir() and name not in ("factsieve.llm", "corpus_pipeline"):
        pytest.skip("the optional part is not there")
    found = imported_without(name)
    assert found.returncode == 0, found.stderr[-500:]


def test_a_broken_part_of_the_library_is_an_error():
    found = imported_without("factsieve.operators.joins")
    assert found.returncode and "factsieve.operators" in found.stderr
