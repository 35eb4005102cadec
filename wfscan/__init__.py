"""wfscan: a PySpark-native analytics engine for auditing package, workflow and tool-server ecosystems."""

__version__ = "0.1.0"
