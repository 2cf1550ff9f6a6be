"""Readers: diffs, git, file trees, linter output, model responses, earlier reports, configuration."""
