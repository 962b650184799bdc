"""Workers get the package from the session, wherever the driver was started."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from revlens.operators import structure
from revlens.session import build_session
spark = build_session("ship", "local[1]", spark__ui__enabled="false")
files = spark.createDataFrame([("r", "s", "h", "head", "a.py", "def f():\\n    return 1\\n")],
                              "repository_id string, snapshot_id string, head_sha string, side string, path string, code string")
print("ROWS", structure.python_facts(files).count())
"""


def test_syntax_extraction_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "ROWS 1" in done.stdout, done.stderr[-1500:]
