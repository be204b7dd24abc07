"""Task retries do not change the salted join's rows (see tests/retry_check.py)."""

from __future__ import annotations

import os
import subprocess
import sys


def test_salted_join_survives_a_failed_task():
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retry_check.py")
    proc = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=600)
    assert proc.returncode == 0, proc.stdout[-2000:] + proc.stderr[-4000:]
    assert "retry check passed" in proc.stdout
