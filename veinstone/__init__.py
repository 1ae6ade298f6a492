"""veinstone: a PySpark-native analytics engine for a catalogue of code functions and their contracts."""

__version__ = "0.1.0"
