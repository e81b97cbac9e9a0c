"""Where images and patches come from and go to."""
