"""How a solve is carried out: where its vectors live, and which of the ways is taken."""
