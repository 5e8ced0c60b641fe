"""What a shell command is about: a subject and tags. A program is looked up, not matched by a chain of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subject, tags, programs, and files or devices that tell the subject wherever they stand.
TOPICS = (
    ("GPU", ("gpu", "nvidia", "hardware"), ("nvidia-smi", "nvtop"), r"(?i)\blspci\b.*\b(?:vga|nvidia|3d)\b"),
    ("CPU", ("cpu", "hardware"), ("lscpu", "nproc"), "/proc/cpuinfo"),
    ("Memory (RAM)", ("ram", "memory", "hardware"), ("free",), "/proc/meminfo"),
    ("Disks and filesystems", ("disk", "storage"), ("df", "lsblk", "du", "mount", "findmnt"), None),
    ("Operating system", ("os", "kernel", "host"), ("uname", "hostnamectl", "lsb_release"), "/etc/os-release"),
    ("Listening ports", ("ports", "network"), ("ss", "netstat"), r"(?i)^lsof\s+-i\b"),
    ("vLLM server", ("vllm",), ("vllm",), None),
    ("Docker containers", ("docker",), ("docker", "podman", "docker-compose", "podman-compose"), None),
    ("systemd services", ("systemd",), ("systemctl",), None),
    ("Kubernetes", ("kubernetes",), ("kubectl",), None),
)
#: Programs that act on one thing: how its subject starts, its tag, the programs, and their verbs.
NAMED = (
    ("Docker container ", "docker", ("docker", "podman"), ("attach", "exec", "inspect", "kill", "logs", "port", "restart", "rm", "start", "stats", "stop", "top")),
    ("systemd service ", "systemd", ("systemctl",), ("disable", "enable", "is-active", "is-enabled", "reload", "restart", "start", "status", "stop")),
)


def topic(command: Column) -> Column:
    """struct<subject, tags>; an empty subject and no tags for null, empty and unknown commands. sudo and env are skipped."""
    cmd = F.regexp_replace(F.btrim(F.coalesce(command, F.lit(""))), r"^(?:(?:sudo|env\s+\S+=\S+)\s+)*", "")
    ranks = F.create_map(*[F.lit(x) for k, t in enumerate(TOPICS) for p in t[2] for x in (p, k)])
    ask = lambda p: F.try_element_at(ranks, F.lower(F.regexp_extract(cmd, p, 0)))
    anywhere = [F.when(cmd.rlike(t[3]), F.lit(k)) for k, t in enumerate(TOPICS) if t[3]]
    rank = F.least(F.coalesce(ask(r"^[\w-]+"), ask(r"^\w+")), *anywhere)
    made = lambda subject, tags: F.struct(subject.alias("subject"), tags.alias("tags"))
    tags = F.array(*[F.array(*map(F.lit, t[1])) for t in TOPICS])
    out = F.when(rank.isNotNull(), made(F.get(F.array(*[F.lit(t[0]) for t in TOPICS]), rank), F.get(tags, rank)))
    out = out.otherwise(made(F.lit(""), F.array().cast("array<string>")))
    args = F.filter(F.split(cmd, r"\s+"), lambda w: ~w.startswith("-"))  # options aside: program, verb, and what it is done to
    thing = F.get(F.filter(F.slice(args, 3, 1 << 20), lambda w: w.rlike(r"^[A-Za-z0-9][\w.@-]*$") & ~w.rlike(r"^[0-9]+$")), F.lit(0))
    for start, tag, programs, verbs in NAMED:
        named = F.lower(F.get(args, F.lit(0))).isin(*programs) & F.get(args, F.lit(1)).isin(*verbs) & thing.isNotNull()
        out = F.when(named, made(F.concat(F.lit(start), thing), F.array(F.lit(tag)))).otherwise(out)
    return out
