"""Where manifests come from and go to."""
