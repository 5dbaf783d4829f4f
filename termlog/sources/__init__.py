"""Where facts come from: tables, random graphs, command scripts, records."""
