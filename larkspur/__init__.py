"""Text de-identification and corpus preparation on Spark."""

from importlib import import_module

__version__ = "0.2.0"
_HOMES = {
    "larkspur.operators.backends": ["SpanPlugin"],
    "larkspur.operators.vault": ["VaultTable"],
    "larkspur.plans.firewall": ["Anonymized", "Firewall", "mock_model"],
    "larkspur.sdk": ["Sdk"],
    "larkspur.sources.catalog": ["Catalog", "Pattern"],
    "larkspur.sources.profiles": ["Disposition", "Profile", "custom_profile", "preset", "preset_names"],
}
__all__ = sorted(name for names in _HOMES.values() for name in names)


def __getattr__(name: str):
    """Names of the package are imported when they are first asked for: workers need few of them."""
    home = next((module for module, names in _HOMES.items() if name in names), None)
    if home is None:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(home), name)
