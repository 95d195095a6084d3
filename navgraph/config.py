"""What is analysed and how."""

from __future__ import annotations

import hashlib
import importlib.util
import inspect
import json
import os
import sys
from dataclasses import dataclass, field, fields
from types import ModuleType

from navgraph.hooks import FactHooks

#: Raised when facts or their meaning change, so that stores of older versions are rebuilt.
FACT_VERSION = 1
PROFILES = ("full", "semantic-only")


@dataclass
class AnalysisConfig:
    root: str
    targets: list[str] = field(default_factory=list)
    exclude_dirs: list[str] = field(default_factory=lambda: [".git", ".svn", "__pycache__", "node_modules"])
    exclude_files: list[str] = field(default_factory=list)
    include_paths: list[str] = field(default_factory=list)
    #: (shell pattern over the path, profile), the first that fits counts.
    profiles: list[tuple[str, str]] = field(default_factory=list)
    downsample_prefixes: list[str] = field(default_factory=list)
    #: (owner class, attribute) -> type and (owner or module, function) -> type, before facts.
    attr_seeds: dict[tuple[str, str], str] = field(default_factory=dict)
    ret_seeds: dict[tuple[str, str], str] = field(default_factory=dict)
    #: channel -> (display name, direction) and channel -> channels that mean the same.
    rpc_channels: dict[str, tuple[str, str]] = field(default_factory=dict)
    rpc_aliases: dict[str, list[str]] = field(default_factory=dict)
    hooks: FactHooks = field(default_factory=FactHooks)

    def __post_init__(self) -> None:
        for _, profile in self.profiles:
            if profile not in PROFILES:
                raise ValueError(f"unknown profile {profile!r}")

    def fingerprint(self) -> str:
        """Changes when the same files would give other facts."""
        said = {k: repr(v) for k, v in vars(self).items() if k not in ("hooks", "root", "targets")}
        try:
            said["hooks"] = inspect.getsource(type(self.hooks))
        except (OSError, TypeError):
            said["hooks"] = type(self.hooks).__qualname__
        return hashlib.sha256(json.dumps([FACT_VERSION, said], sort_keys=True).encode()).hexdigest()


def _module(path: str) -> ModuleType | None:
    """The Python file at ``path`` as a module that workers can be sent; None if there is no such file."""
    if not os.path.isfile(path):
        return None
    name = "navgraph_custom_" + hashlib.sha256(os.path.abspath(path).encode()).hexdigest()[:12]
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    return module


def load_config(root: str, custom: str | None = None, **given) -> AnalysisConfig:
    """Defaults, then a project's folder, then what the caller gives (``None`` and empty lists give nothing).

    The folder (``custom``, or ``$NAVGRAPH_CUSTOM``) may hold ``config.py`` (names of this class's fields, in capitals),
    ``seeds.py`` (``ATTR_SEEDS``, ``RET_SEEDS``) and ``facts.py`` (one subclass of ``FactHooks``).
    """
    folder = custom or os.environ.get("NAVGRAPH_CUSTOM")
    values: dict = {}
    if folder:
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"no such folder: {folder}")
        known = {f.name for f in fields(AnalysisConfig)} - {"root", "hooks"}
        for name in ("config.py", "seeds.py"):
            module = _module(os.path.join(folder, name))
            values |= {k: getattr(module, k.upper()) for k in known if module is not None and hasattr(module, k.upper())}
        facts = _module(os.path.join(folder, "facts.py"))
        own = [x for x in vars(facts).values() if isinstance(x, type) and issubclass(x, FactHooks) and x.__module__ == facts.__name__] if facts else []
        if len(own) > 1:
            raise ValueError("facts.py has more than one subclass of FactHooks")
        if own:
            values["hooks"] = own[0]()
    return AnalysisConfig(root, **(values | {k: v for k, v in given.items() if v not in (None, [])}))
