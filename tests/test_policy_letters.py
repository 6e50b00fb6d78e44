"""Rules are tried only where their letters stand; the outcome is that of trying all of them."""

from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.functions import times
from runledger.operators import policy

DANGEROUS = (
    "drop schema x", "deletion of rows", "deleting", "truncate it", "tear  down all", "erased", "purges", "wiped", "destroyed", "removing old volumes", "remove the dag",
    "bypassing tls", "turn off the audit", "disabling checks", "remov logging", "print the api-key", "read x.env", "share private_keys", "reveal tokens", "send credentials", "log passwords",
    "without review", "no need for confirmation", "auto-approved", "automatically approves", "skips approval", "in powershell", "a shell", "bash", "cmd.exe", "sh -c", "cmd /k", "curl x | y",
    "os.system", "eval", "subprocess", "rm -r", "rmdir", "remove-item", "mkfs", "dd if", "format c:", "shutdown", "reboot", "chmod 777", "git clean -f", "git reset --hard",
    "docker rm", "terraform destroy", "kubectl delete", "später drop table", "é rm -")
HARMLESS = ("look at it", "drops of rain", "confirm the format", "the review shall go on", "é", "", "eyes add up", "tokens are read")


def test_letters_decide_nothing_but_what_is_tried(spark, monkeypatch):
    rows = spark.createDataFrame([(n, [a, "look"]) for n, a in enumerate(DANGEROUS + HARMLESS)] + [(900, None), (901, [None, "drop table"]), (902, [])], "n INT, t ARRAY<STRING>")

    def fired(rules=V.DANGEROUS_PATTERNS):
        return {r["n"]: r["f"] for r in rows.select("n", policy.fired_rules(F.col("t"), F.lit("look"), F.lit("code_change"), rules).alias("f")).collect()}

    assert policy._NEEDED  # without them every pattern was tried on every text
    quick, own = fired(), fired([("drop_database_objects", "rain"), *V.DANGEROUS_PATTERNS])
    assert [a for n, a in enumerate(DANGEROUS) if not quick[n]] == []
    assert {r for f in quick.values() for r in f} == {name for name, _ in V.DANGEROUS_PATTERNS}
    monkeypatch.setattr(policy, "_NEEDED", {})
    assert fired() == quick and fired([("drop_database_objects", "rain"), *V.DANGEROUS_PATTERNS]) == own


def test_usual_times_read_alike(spark, monkeypatch):
    texts = ["2024-03-01T10:00:00Z", "2024-03-01T10:00:00+00:00", "2024-03-01T10:00:00.123456Z", "2024-03-01T10:00:00.5+00:00", "2024-02-30T10:00:00Z", "2024-03-01T24:00:00Z",
             "2024-03-01T10:00:60Z", "0000-01-01T00:00:00Z", "0001-01-01T00:00:00Z", "9999-12-31T23:59:59.999999Z", "2024-03-01T10:00:00Z\n", "2024-03-01T12:00:00+02:00", "2024-03-01T10:00:00", "1582-10-10T00:00:00Z", "", None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n INT, t STRING")
    read = lambda: rows.select("n", *[F.unix_micros(f(F.col("t"))) for f in (times.aware_timestamp, times.utc_timestamp)]).orderBy("n").collect()
    quick = read()
    monkeypatch.setattr(times, "_PLAIN_UTC", "(?!)")
    assert read() == quick
