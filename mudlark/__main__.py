from mudlark.cli import main

raise SystemExit(main())
