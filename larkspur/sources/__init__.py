"""Configuration and input: patterns, profiles, languages, models."""
