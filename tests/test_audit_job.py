import audit_job
import pytest


def test_options_are_the_settings_of_the_audit():
    line = ["f.csv", "--target", "y", "--task", "regression", "--model", "ridge", "--bootstrap", "50", "--test-size", "0.2"]
    got = vars(audit_job.options().parse_args(line))
    assert got == {
        "csv": "f.csv", "output": "audit-report", "target": "y", "task": "regression", "model": "ridge", "severity": 0.15, "repeats": 12,
        "test_size": 0.2, "bootstrap_samples": 50, "seed": 2027, "parallelism": 4,
    }
    with pytest.raises(SystemExit):
        audit_job.options().parse_args(["f.csv", "--target", "y", "--task", "ranking", "--model", "ridge"])
