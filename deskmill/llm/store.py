"""Tables that cut lineage, for the operators of this subpackage."""

from deskmill.sources.store import cut, drop, new_path, partitions, shared_dir

__all__ = ["cut", "drop", "new_path", "partitions", "shared_dir"]
