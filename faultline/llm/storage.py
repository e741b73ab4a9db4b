"""Tables in the folder that all executors share: those of the library."""

from ..storage import drop, forget, materialize, new_path, open_fs, release, shared_dir

__all__ = ["drop", "forget", "materialize", "new_path", "open_fs", "release", "shared_dir"]
