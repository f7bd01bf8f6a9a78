"""Scans, sinks and the proxy panel made from star-schema tables."""
