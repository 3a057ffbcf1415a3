"""Where texts come from: files of several kinds, and a stream of changed files."""
