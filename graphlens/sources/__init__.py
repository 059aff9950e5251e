"""Where rows come from and go to: repositories, configuration formats, tools' outputs, reports."""
