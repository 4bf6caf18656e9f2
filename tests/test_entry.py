import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "quarry"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "quarry").mkdir()
    for part in (ROOT / "quarry").iterdir():
        if part.name != "llm":
            (tmp_path / "quarry" / part.name).symlink_to(part)
    code = "import sys; sys.path.insert(0, sys.argv[1]); import importlib.util as u; s = u.spec_from_file_location('e', sys.argv[1] + '/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), any(k.startswith('op1_') for k in m.queries()))"
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, timeout=120)
    assert out.stdout.split()[-1] == "False", out.stderr
