"""The entry adds the optional queries only where they can be imported."""
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
for name in {names!r}:
    sys.modules[name] = None
import __spark_entry__ as E
print(len(E.queries()), sorted(k for k in E.queries() if k.startswith("op") and k[2:3].isdigit() or k == "pipeline"))
"""


def keys(*names):
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(names=names)], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.strip().splitlines()[-1]


def test_core_queries_stay_without_the_optional_packages():
    core = keys("venturelens.llm", "corpus_pipeline")
    assert core.endswith("[]") and int(core.split()[0]) > 70
    assert keys("xxhash") == core          # a library that only the subpackage needs
