"""The library stands without its optional part."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("vitalcov.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = entry.queries()
assert "birth_coverage" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert names.keys() == entry.oracle_sql().keys()
"""


def test_queries_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).parents[1], check=True)


def test_packages_that_only_the_corpus_operators_need():
    broken = CODE.replace('name == "corpus_pipeline" or name.startswith("vitalcov.llm")', 'name == "public_tokenizers"')
    done = subprocess.run([sys.executable, "-c", broken], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    assert "no corpus operators: public_tokenizers" in done.stderr
