"""Where rows come from and go to: keyed tables, files, run and model tables."""
