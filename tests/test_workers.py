"""Worker code must not need the package on the executors' import path."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from cohortloom.session import build_session
from cohortloom.plans import catalog
spark = build_session(master="local[2]", partitions=2)
for name in ("logit_fit", "ols_by_probe", "random_intercept", "rubin_pool", "probe_fdr"):
    assert catalog.QUERIES[name](spark, {data!r}).count() > 0
print("workers ok")
"""


def test_package_is_not_needed_on_workers(tmp_path, small):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, data=small)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "workers ok" in out.stdout, out.stderr[-2000:]
