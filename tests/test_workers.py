"""Worker functions travel with their code: no executor needs the package on its path."""

import os
import subprocess
import sys

from conftest import ROOT, SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from roomledger.session import get_session
spark = get_session("local[2]", 2)
import __spark_entry__ as E
print("rows", E.queries()["admit_reservations"](spark, {sf!r}).count())
"""


def test_admission_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=SMALL)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert "rows 1500" in out.stdout, out.stderr[-2000:]
