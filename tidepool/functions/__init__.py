"""Column-level building blocks (all JVM-side built-ins, no Python UDFs)."""

from tidepool.functions.hashing import hash52, hash_bucket  # noqa: F401
