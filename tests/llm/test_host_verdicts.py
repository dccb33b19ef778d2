"""Host verdicts of the quality rules against plain Python."""

import math

from timberline.llm import quality_rules

LONG = " ".join(f"w{k}" for k in range(30))
COLUMNS = "doc_id bigint, text string, source string, n bigint, host string, kept string"


def by_hand(hosts, deviations=3.0):
    """hosts: {name: [per rule failures] per document}; gives (rates, rejected) of each."""
    counts = {h: (len(rows), [sum(r[k] for r in rows) for k in range(4)]) for h, rows in hosts.items()}
    out = {h: ([], False) for h in hosts}
    for k in range(4):
        scaled = [10_000 * c[k] // n for n, c in counts.values()]
        mean = sum(scaled) / len(scaled) / 10_000
        m = max(min(mean, 0.999), 0.001)
        chance = m * (1 - m) * sum(1_000_000 // n for n, _ in counts.values()) / len(counts) / 1e6
        v = max(sum(x * x for x in scaled) / len(scaled) / 1e8 - mean * mean - chance, 1e-9)
        s = max(1, min(1000, m * (1 - m) / v - 1))
        for h, (n, c) in counts.items():
            rate = (c[k] + m * s) / (n + s)
            out[h] = out[h][0] + [rate], out[h][1] or rate > m + deviations * math.sqrt(m * (1 - m) / (s + 1))
    return out


def made():
    rows = []
    for h in range(20):
        for k in range(40):
            # Host 3 repeats its lines, host 5 is full of symbols; both keep every document rule. Others fail now and then.
            text = (LONG + "\n" + "\n".join(["buy now"] * 4) if h == 3 else LONG + " #" * 200 if h == 5 and k % 8 else "few words" if (h + k) % 11 == 0 else LONG + f" {h}")
            rows.append((100 * h + k, text, f"host{h}"))
    return rows


def failures(text):
    w = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    again = {x for x in windows if windows.count(x) > 1}
    covered = {j for k, x in enumerate(windows) if x in again for j in range(k, k + 8)}
    return [len(w) < 20, 100 * len(covered) > 30 * len(w), 10 * sum(text.count(c) for c in "#*$%&|<>") > sum(map(len, w)),
            10 * (len(lines) - len(set(lines))) > 3 * len(lines)]


def test_bad_hosts_lose_their_documents(spark):
    rows = made()
    hosts: dict[str, list] = {}
    for _, text, host in rows:
        hosts.setdefault(host, []).append(failures(text))
    expected = by_hand(hosts)
    found = quality_rules.apply(spark.createDataFrame([(*r, 1, "h", "k") for r in rows], COLUMNS)).collect()
    assert len(found) == len(rows)
    of = {i: (text, host) for i, text, host in rows}
    for r in found:
        text, host = of[r.doc_id]
        rates, rejected = expected[host]
        own = [r[f"{name}_rate"] for name in quality_rules.RULES]
        assert all(abs(a - b) < 1e-9 for a, b in zip(own, rates, strict=True)) and r.host_rejected == rejected
        assert r.base_failed == any(failures(text)[:2]) and r.kept == (not r.base_failed and not rejected)
    assert {of[r.doc_id][1] for r in found if r.host_rejected} >= {"host3"}
    assert any(r.host_rejected and not r.base_failed for r in found) and sum(r.kept for r in found) > 500


def test_hosts_alike_are_all_kept(spark):
    rows = [(i, "few words" if i % 2 else LONG, f"host{i // 40}", 1, "h", "k") for i in range(800)]
    assert not any(r.host_rejected for r in quality_rules.apply(spark.createDataFrame(rows, COLUMNS)).collect())


def test_one_host_and_null_hosts(spark):
    rows = [(1, None, None, 1, "h", "k"), (1, None, None, 1, "h", "k"), (None, LONG, None, 1, "h", "k"), (2, LONG * 2000, None, 1, "h", "k")]
    found = quality_rules.apply(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(found) == 4 and not any(r.host_rejected for r in found) and sum(r.base_failed for r in found) == 3
    assert quality_rules.apply(spark.createDataFrame([], COLUMNS)).count() == 0
